"""Work lists: which sweeps and decks are next, and when a new cycle starts.

The lists are read-only queries; leases are stamped, if at all, by the one
batch that hands the list out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckspark.functions import scalars as S
from deckspark.functions.formats import BATCH_SIZE, LEASE_MINUTES, PENDING, priority
from deckspark.operators.cards import names_of
from deckspark.operators.ordered import global_row_number


def lease_expired(as_of: Column, minutes: int = LEASE_MINUTES, at: str = "claimed_at") -> Column:
    """Strictly older than the lease; null where there is no lease."""
    return F.col(at) < as_of - F.make_dt_interval(mins=F.lit(minutes))


def sweep_available(as_of: Column) -> Column:
    return ~F.col("swept") & (F.col("claimed_at").isNull() | lease_expired(as_of))


def deck_available(as_of: Column) -> Column:
    stale = (F.col("status") == "claimed") & lease_expired(as_of)
    return (F.col("status") == "discovered") | F.coalesce(stale, F.lit(False))


def pending(status: Column) -> Column:
    return status.isin(*PENDING)


def next_sweeps(status: DataFrame, as_of: Column, k: int = 1) -> DataFrame:
    """The k sweep units to run next.

    Units never swept come first, then the ones never or least recently leased.
    A sort with a limit: each task keeps k rows.
    """
    return (
        status.filter(sweep_available(as_of))
        .orderBy(
            F.col("ever_swept").asc_nulls_last(),
            F.col("claimed_at").asc_nulls_first(),
            F.col("card_id").asc_nulls_last(),
            F.col("format").asc_nulls_last(),
        )
        .limit(k)
    )


def sweep_worklist(status: DataFrame, cards: DataFrame, as_of: Column, k: int = 1) -> DataFrame:
    """``next_sweeps`` with the card's name, the name to search for, and the mode."""
    return sweep_units(next_sweeps(status, as_of, k), cards)


def sweep_units(units: DataFrame, cards: DataFrame) -> DataFrame:
    """Units with the card's name, the name to search for, and the mode."""
    return names_of(units, cards).select(
        "card_id",
        "card_name",
        S.search_name(F.col("card_name")).alias("search_name"),
        "format",
        S.sweep_mode(F.col("ever_swept")).alias("mode"),
    )


def deck_worklist(
    decks: DataFrame, as_of: Column, n: int = BATCH_SIZE, rank: Column | None = None
) -> DataFrame:
    """Up to n decks to fetch next, all of the first format that has any.

    The first n rows by (priority, age) hold the wanted ones at their head, so
    one sort with a limit is enough; the last step only looks at those n rows.
    """
    ranked = decks.filter(deck_available(as_of)).withColumn(
        "_priority", priority(F.col("format")) if rank is None else rank
    )
    head = ranked.orderBy(
        F.col("_priority").asc_nulls_last(),
        F.col("scraped_at").asc_nulls_last(),
        F.col("moxfield_id").asc_nulls_last(),
    ).limit(n)
    first = F.min("_priority").over(Window.partitionBy())
    return head.withColumn("_first", first).filter("_priority = _first").drop("_priority", "_first")


def number_batches(decks: DataFrame, as_of: Column, n: int = BATCH_SIZE) -> DataFrame:
    """All decks to fetch, cut into batches of n per format, oldest first.

    There are only six formats, so the numbering must not be a window per format.
    """
    waiting = decks.filter(deck_available(as_of)).select("format", "scraped_at", "moxfield_id")
    numbered = global_row_number(waiting, ["scraped_at", "moxfield_id"], within=("format",), out="place")
    return numbered.select(
        "format",
        "moxfield_id",
        F.expr(f"(place - 1) DIV {int(n)}").alias("batch"),
    )


def stamp_leases(table: DataFrame, claimed: DataFrame, key: list[str], worker: str, as_of: Column) -> DataFrame:
    """The table with the lease columns of the claimed rows set (and deck status, if there is one).

    ``claimed`` is a work list: as short as its limit.
    """
    mark = claimed.select(*key, F.lit(True).alias("_claimed"))
    rows = table.join(mark, key, "left")
    hit = F.coalesce("_claimed", F.lit(False))
    columns = {c: F.col(c) for c in table.columns}
    columns["claimed_at"] = F.when(hit, as_of).otherwise(F.col("claimed_at"))
    columns["claimed_by"] = F.when(hit, F.lit(worker)).otherwise(F.col("claimed_by"))
    if "status" in columns:
        columns["status"] = F.when(hit, "claimed").otherwise(F.col("status"))
    return rows.select(*[c.alias(name) for name, c in columns.items()])


def stale_leases(decks: DataFrame, as_of: Column, minutes: int = LEASE_MINUTES) -> DataFrame:
    """Expired deck leases per holder."""
    return (
        decks.filter((F.col("status") == "claimed") & lease_expired(as_of, minutes))
        .groupBy("claimed_by")
        .agg(F.count("*").alias("stale"), F.min("claimed_at").alias("oldest"))
    )


def drained_formats(decks: DataFrame) -> DataFrame:
    """Per format: pending decks, and whether none is left."""
    return decks.groupBy("format").agg(
        F.count_if(pending(F.col("status"))).alias("pending"),
        (~F.bool_or(pending(F.col("status")))).alias("drained"),
    )


def complete_sweeps(status: DataFrame, completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark completed units as swept, and list completions that match no unit.

    ``completions`` holds ``card_id`` (null for an unknown card) and ``format``.
    """
    key = ["card_id", "format"]
    done = completions.select(*key).distinct().withColumn("_done", F.lit(True))
    hit = F.coalesce("_done", F.lit(False))
    marked = status.join(done, key, "left").select(
        *[
            (F.col(c) | hit).alias(c) if c in ("swept", "ever_swept") else F.col(c)
            for c in status.columns
        ]
    )
    return marked, completions.join(status.select(*key), key, "left_anti")


def apply_work(status: DataFrame, work: DataFrame) -> DataFrame:
    """Sweep units after what was handed out, completed and reset since ``status`` was written.

    The last claim is the lease, also of a unit that is completed. Completions count as swept until the
    next reset, and for ever as ``ever_swept``. The log of a unit is combined before it is joined; only the
    number of the last reset goes to the driver.
    """
    key = ["card_id", "format"]
    reset = work.filter("kind = 'reset'").agg(F.max("batch")).first()[0]
    claim, complete = F.col("kind") == "claim", F.col("kind") == "complete"
    events = work.filter("card_id IS NOT NULL").groupBy(*key).agg(
        F.max_by(F.when(claim, F.struct("at", "holder")), F.when(claim, F.col("batch"))).alias("_lease"),
        F.max(F.when(complete, F.col("batch"))).alias("_completed"),
    )
    before = F.col("swept") if reset is None else F.lit(False)
    now = F.col("_completed").isNotNull() if reset is None else F.coalesce(F.col("_completed") > reset, F.lit(False))
    columns = {c: F.col(c) for c in status.columns} | {
        "swept": before | now,
        "ever_swept": F.col("ever_swept") | F.col("_completed").isNotNull(),
        "claimed_at": F.coalesce(F.col("_lease")["at"], "claimed_at"),
        "claimed_by": F.when(F.col("_lease").isNotNull(), F.col("_lease")["holder"]).otherwise(F.col("claimed_by")),
    }
    return status.join(events, key, "left").select(*[c.alias(name) for name, c in columns.items()])


def without_leased(decks: DataFrame, work: DataFrame, as_of: Column) -> DataFrame:
    """Decks that no claim of the log holds at ``as_of``; the log is that since the decks were built."""
    key = ["format", "moxfield_id"]
    claims = work.filter("kind = 'claim' AND moxfield_id IS NOT NULL").groupBy(*key).agg(F.max("at").alias("_at"))
    held = claims.filter(~lease_expired(as_of, at="_at"))
    return decks.join(held, key, "left_anti")


def cycle_is_over(status: DataFrame, decks: DataFrame, as_of: Column) -> bool:
    """Nothing left to sweep and no deck waiting: two probes that stop at the first row."""
    if not status.filter(sweep_available(as_of)).isEmpty():
        return False
    return decks.filter(pending(F.col("status"))).isEmpty()


def start_cycle(status: DataFrame) -> DataFrame:
    """Every unit is to be swept again; leases and ``ever_swept`` stay."""
    return status.withColumn("swept", F.lit(False))


def next_cycle(status: DataFrame, decks: DataFrame, as_of: Column) -> DataFrame:
    return start_cycle(status) if cycle_is_over(status, decks, as_of) else status
