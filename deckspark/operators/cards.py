"""The card dimension: parse, keep the first of each name, merge, fan out to formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckspark.functions import scalars as S
from deckspark.functions.formats import formats_of_card
from deckspark.operators.ordered import first_per_key, global_row_number
from deckspark.operators.skew import BROADCAST_BYTES, fits_broadcast, lookup_join
from deckspark.schemas import CARD_COLUMNS, CORRUPT, LEGALITIES
from deckspark.session import shared_dir


def parse_cards(raw: DataFrame) -> DataFrame:
    """Raw card objects to the flat columns; ``ordinal`` is passed through if present."""
    same = ("oracle_id", "layout", "mana_cost", "type_line", "oracle_text", "power", "toughness",
            "loyalty", "defense", "rarity", "edhrec_rank")
    columns = {name: F.col(name) for name in same}
    columns |= {
        "card_name": F.coalesce(F.col("name"), F.lit("")),
        "scryfall_id": F.col("id"),
        "cmc": F.coalesce(F.col("cmc"), F.lit(0.0)).cast("float"),
        "color_mask": S.color_mask(F.col("colors")),
        "ci_mask": S.color_mask(F.col("color_identity")),
        "reserved": S.flag(F.col("reserved")),
        "textless": S.flag(F.col("textless")),
        "game_changer": S.flag(F.col("game_changer")),
        "image_uri": S.image_uri(F.col("image_uris"), F.col("card_faces")),
        "keywords_json": S.json_list_text(F.col("keywords")),
    }
    columns |= {f"legal_{name}": F.col("legalities")[name] for name in LEGALITIES}
    passed = [c for c in ("ordinal",) if c in raw.columns]
    return raw.select(*[columns[c].alias(c) for c in CARD_COLUMNS], *passed)


def split_corrupt(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that fit the schema, and the texts of those that do not."""
    good = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = raw.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


def named(cards: DataFrame, name: str = "card_name") -> DataFrame:
    return cards.filter(F.col(name) != "")


def first_of_name(cards: DataFrame, name: str = "card_name", order: str = "ordinal") -> DataFrame:
    """One row per name; the first in file order stays."""
    return first_per_key(named(cards, name), [name], [order])


def count_collisions(cards: DataFrame, name: str = "card_name") -> DataFrame:
    """How many rows repeat a name that came before."""
    per_name = named(cards, name).groupBy(name).agg((F.count("*") - 1).alias("again"))
    return per_name.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("collisions"))


def new_names(stored: DataFrame, incoming: DataFrame, name: str = "card_name") -> DataFrame:
    """Incoming rows whose name is not stored yet."""
    return incoming.join(stored.select(name), name, "left_anti")


def mark_changes(
    stored: DataFrame, incoming: DataFrame, name: str = "card_name", order: str = "ordinal"
) -> DataFrame:
    """Stored and incoming rows as one row per name, with its ``change``: updated, inserted or kept.

    Stored cards keep their id and take over every other incoming column; inserted ones have no id yet, and their
    ``order``. One join, each side once. Both sides are unique by name.
    """
    payload = [c for c in stored.columns if c not in ("id", name)]
    fresh = incoming.select(
        F.col(name).alias("_name"), *[F.col(c).alias(f"_new_{c}") for c in payload], F.col(order).alias("_order")
    )
    both = stored.join(fresh, F.col(name) == F.col("_name"), "full_outer")
    hit, known = F.col("_name").isNotNull(), F.col(name).isNotNull()
    return both.select(
        "id",
        F.coalesce(name, "_name").alias(name),
        *[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        F.when(hit & known, "updated").when(hit, "inserted").otherwise("kept").alias("change"),
        "_order",
    )


def upsert_cards(
    stored: DataFrame, incoming: DataFrame, name: str = "card_name", order: str = "ordinal"
) -> DataFrame:
    """Merge incoming rows into the stored dimension by name.

    New names get the ids after the greatest stored one, in file order; only they are numbered. The joined rows
    are checkpointed, so both sides are evaluated once.
    """
    shared_dir(stored.sparkSession)
    marked = mark_changes(stored, incoming, name, order).checkpoint()
    top = marked.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = global_row_number(marked.filter("change = 'inserted'"), ["_order"], out="_rank")
    ids = (F.lit(top) + F.col("_rank")).cast(stored.schema["id"].dataType)
    added = numbered.withColumn("id", ids).select(*[c for c in marked.columns if c != "_order"])
    return marked.filter("change <> 'inserted'").drop("_order").unionByName(added)


def count_changes(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count_if(F.col("change") == "inserted").alias("inserted"),
    )


def eligible_formats(cards: DataFrame, card_id: str = "id") -> DataFrame:
    """One row per card and format it may be played in."""
    return cards.select(F.col(card_id).alias("card_id"), F.explode(formats_of_card()).alias("format"))


def extend_status(status: DataFrame, cards: DataFrame) -> DataFrame:
    """Add tracking rows for the given cards; rows that exist already stay as they are.

    Pass only newly inserted cards to leave the rows of known cards alone, or
    all cards to add the formats that became legal since.
    """
    missing = eligible_formats(cards).join(
        status.select("card_id", "format"), ["card_id", "format"], "left_anti"
    )
    return status.unionByName(
        missing.select(
            "card_id",
            "format",
            F.lit(False).alias("swept"),
            F.lit(False).alias("ever_swept"),
            F.lit(None).cast("timestamp").alias("claimed_at"),
            F.lit(None).cast("string").alias("claimed_by"),
        )
    )


def resolve_names(entries: DataFrame, cards: DataFrame, **limits: int) -> DataFrame:
    """Add ``card_id`` to rows holding a ``card_name``; unknown names get null."""
    ids = cards.select("card_name", F.col("id").alias("card_id"))
    return lookup_join(entries, ids, ["card_name"], "left", **limits)


def name_slots(cards: DataFrame) -> tuple[DataFrame, int]:
    """The cards' ids by name as one row with one array, and its length: a name's slot follows from its hash."""
    number = max(1, cards.count())
    slot = F.pmod(F.xxhash64("card_name"), F.lit(number))
    per_name = cards.filter("card_name IS NOT NULL").groupBy("card_name").agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").alias("card_id")))).alias("ids")
    )
    filled = per_name.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct("card_name", "ids")).alias("names"))
    every = cards.sparkSession.range(number).select(F.col("id").alias("slot")).join(filled, "slot", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("slot", "names"))).alias("slots"))
    return listed.select(F.transform("slots", lambda s: F.map_from_entries(s["names"])).alias("slots")), number


def resolve_listed(rows: DataFrame, cards: DataFrame, listed: str, entries: Column, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """``resolve_names`` for entries that stay in their row: ``entries`` is an array of them, and ``listed`` will be that array with
    the ``card_id`` of each, and with its place as ``pos`` where it has none.

    No entry leaves its row, so nothing is shuffled. The cards go to all tasks, as with a broadcast; None if they
    are beyond the limit.
    """
    ids = cards.select("card_name", "id")
    if not fits_broadcast(ids, limit):
        return None
    slots, number = name_slots(ids)
    fields = rows.select(entries.alias("e")).schema["e"].dataType.elementType.fieldNames()
    unknown = F.array(F.struct(F.lit(None).cast(ids.schema["id"].dataType).alias("card_id")))

    def found(name: Column) -> Column:
        return F.coalesce(F.get("_slots", F.pmod(F.xxhash64(name), F.lit(number)).cast("int"))[name], unknown)

    def resolved(e: Column, i: Column) -> Column:
        place = [] if "pos" in fields else [i.alias("pos")]
        return F.transform(
            found(e["card_name"]), lambda c: F.struct(*place, *[e[f].alias(f) for f in fields], c["card_id"].alias("card_id"))
        )

    # Named once here and used once there, the value is put into the expression and not into the rows.
    return rows.withColumn("_slots", slots.scalar()).withColumn(listed, F.flatten(F.transform(entries, resolved))).drop("_slots")


def names_of(units: DataFrame, cards: DataFrame, **limits: int) -> DataFrame:
    """Add ``card_name`` to rows holding a ``card_id``; ids without a card drop out."""
    names = cards.select(F.col("id").alias("card_id"), "card_name")
    return lookup_join(units, names, ["card_id"], "inner", **limits)


def card_usage(entries: DataFrame, cards: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries and copies per card (and group); counted by name before the lookup.

    Only one row per group and name reaches the join, however often a staple
    card is played. Names without a card are reported under a null id.
    """
    by = by or []
    per_name = entries.groupBy(*by, "card_name").agg(
        F.count("*").alias("entries"), F.sum("quantity").alias("copies")
    )
    return resolve_names(per_name, cards)
