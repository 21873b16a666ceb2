"""The operators over the given tables.

The tables hold no decks, so each query says which table stands in for what:
words of ``documents`` are deck entries, the vocabulary of ``benchmark`` is the
card table, ``part`` gives card objects, ``orders`` and ``events`` give stubs,
leases and event logs. Every query reads its tables whole.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deckspark.functions import scalars as S
from deckspark.operators import cards as C
from deckspark.operators import lifecycle, paging, quality, stats, stubs, submissions, worklist
from deckspark.operators.ordered import first_per_key, global_row_number
from deckspark.operators.skew import spread
from deckspark.plans.corpus import BUILDS, Corpus
from deckspark.plans.handout import Handout
from deckspark.plans.seed import seed_cards
from deckspark.schemas import CARD_FORMAT_STATUS, CARDS, DECK_CARDS, DECKS, STATUS_DEFAULTS, STUB_LOG, SUBMISSION_LOG, WORK_LOG
from deckspark.session import shared_dir
from deckspark.sources.cards import parse_export
from deckspark.sources.files import is_committed
from deckspark.sources.keyed import KeyedTable
from deckspark.sources.landings import read_details, read_pages
from deckspark.sources.snapshots import SnapshotTable
from deckspark.sources.unknown import append_unknown, read_unknown
from deckspark.streaming.discovery import StubSink, start_stubs
from deckspark.streaming.lifecycle import STATE, keep_states, start_states
from deckspark.streaming.logs import BatchLog, WorkLog
from deckspark.streaming.submissions import SubmissionSink, start_submissions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table of texts that are about to be taken apart."""
    return spread(table(spark, sf_dir, name).select(key, *columns), key)


# --- stand-ins -------------------------------------------------------------------------------

#: Cut between what is stored and what comes in, for tables with a date.
CUT = "timestamp_ntz'1998-01-01 00:00:00'"
AS_OF = "timestamp_ntz'2024-01-15 00:00:00'"

DECK_FORMAT = (
    "CASE lang WHEN 'en' THEN 'commander' WHEN 'fr' THEN 'highlanderCanadian' "
    "WHEN 'de' THEN 'modern' ELSE 'pauper' END"
)
BOARD = (
    "CASE WHEN substr(w, 1, 1) BETWEEN 'A' AND 'Z' THEN 'commanders' "
    "WHEN w LIKE '%.' THEN 'sideboard' ELSE 'mainboard' END"
)


def digested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a digest of the whole text in its place: equal texts meet without being moved."""
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("digest", F.sha2("text", 256)).drop("text")


def words(df: DataFrame, *keys: str) -> DataFrame:
    """Words of whole texts with their position; ``text`` may hold many lines."""
    return df.select(*keys, F.posexplode(F.split("text", " ")).alias("pos", "w"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of ``benchmark`` as cards, numbered by first appearance."""
    seen = words(table(spark, sf_dir, "benchmark"), "item_id").filter("w <> ''")
    per_word = seen.groupBy(F.col("w").alias("card_name")).agg(
        F.min(F.shiftleft("item_id", 32) + F.col("pos")).alias("ordinal"), F.count("*").alias("seen")
    )
    numbered = global_row_number(per_word, ["ordinal"], out="id")
    return numbered.select(F.col("id").cast("int").alias("id"), "card_name", "seen")


def deck_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` as deck entries."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "lang", "text").withColumn("format", F.expr(DECK_FORMAT))
    return words(docs, "format", "doc_id").select(
        "format",
        F.col("doc_id").cast("string").alias("moxfield_id"),
        "pos",
        F.expr(BOARD).alias("board"),
        F.col("w").alias("card_name"),
        (F.length("w") - 4).alias("quantity"),
    ).filter("card_name <> ''")


def landed(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame) -> str:
    """Folder with the given JSON lines, packed; written once per application and table folder."""
    folder = landing_folder(spark, sf_dir, name)
    if not is_committed(spark, folder):
        lines.write.mode("overwrite").option("compression", "gzip").text(folder)
    return folder


def landing_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    source = hashlib.md5(sf_dir.encode()).hexdigest()
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{source}/{name}"


def land_documents(spark: SparkSession, sf_dir: str, name: str, failed: Column) -> str:
    """``documents`` as deck documents, landed as JSON; ``failed`` ones stand for reports that fetching failed."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "lang", "n_chars", "text")
    split = docs.withColumn("words", F.expr("transform(split(text, ' '), (w, i) -> struct(i, w))"))

    def board(name: str) -> Column:
        mine = f"filter(words, x -> {BOARD.replace('w,', 'x.w,').replace('w LIKE', 'x.w LIKE')} = '{name}')"
        return F.expr(
            f"map_from_entries(transform({mine}, x -> struct(CAST(x.i AS STRING), "
            "named_struct('quantity', length(x.w) - 4, 'card', named_struct('name', x.w)))))"
        ).alias(name)

    rendered = split.select(
        F.to_json(
            F.struct(
                F.expr(DECK_FORMAT).alias("format"),
                F.col("doc_id").cast("string").alias("moxfield_id"),
                F.col("doc_id").alias("seq"),
                failed.alias("error"),
                *[board(b) for b in ("sideboard", "mainboard", "commanders")],
            )
        ).alias("json")
    )
    return landed(spark, sf_dir, name, rendered)


def deck_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as fetched deck documents, read like any landing."""
    return read_details(spark, land_documents(spark, sf_dir, "details", F.lit(False)))


def card_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as card objects in JSON, with the irregular values real exports have."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.expr(
            """concat('{"name": ', CASE WHEN p_size = 1 THEN 'null' WHEN p_size = 2 THEN '""'
                   WHEN p_size > 40 THEN concat('"', replace(p_name, ' ', ' // '), '"')
                   ELSE concat('"', p_name, '"') END,
               ', "id": "', p_partkey, '", "oracle_id": "', p_brand, '", "layout": "', p_type, '"',
               ', "cmc": ', CASE WHEN p_size = 3 THEN 'null' ELSE CAST(p_size / 2.0D AS STRING) END,
               ', "power": ', p_size, ', "edhrec_rank": ', p_size,
               ', "colors": ["', array_join(split(p_name, ''), '", "'), '"]',
               CASE WHEN p_type = 'PROMO' THEN '' ELSE concat(', "color_identity": [" ', lower(p_type), ' ", "',
                   array_join(split(p_type, ''), ' ", "'), '"]') END,
               CASE WHEN p_size <= 5 THEN ', "reserved": true' WHEN p_size <= 10 THEN ', "reserved": "True"'
                    WHEN p_size <= 15 THEN ', "reserved": "1"' WHEN p_size <= 20 THEN ', "reserved": 1'
                    WHEN p_size <= 25 THEN ', "reserved": 0.0' WHEN p_size <= 30 THEN ', "reserved": []'
                    WHEN p_size <= 35 THEN ', "reserved": [0]' WHEN p_size <= 40 THEN ', "reserved": null'
                    ELSE '' END,
               CASE p_type WHEN 'PROMO' THEN concat(', "image_uris": {"normal": "n', p_partkey, '"}')
                    WHEN 'SMALL' THEN ', "image_uris": {"small": "s", "normal": ""}'
                    WHEN 'LARGE' THEN ', "image_uris": {}, "card_faces": [{"image_uris": {"large": "l"}}]'
                    WHEN 'MEDIUM' THEN ', "card_faces": [{"image_uris": {"png": "p", "art": "a"}}, {}]'
                    ELSE '' END,
               ', "keywords": ', CASE WHEN p_type = 'ECONOMY' THEN 'null'
                    ELSE concat('["', replace(p_name, ' ', '","'), '"]') END,
               ', "legalities": {"commander": "', CASE WHEN p_size > 25 THEN 'legal' ELSE 'banned' END,
               '", "modern": "', CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'legal' ELSE 'not_legal' END,
               '", "vintage": "', CASE WHEN p_type = 'PROMO' THEN 'restricted' ELSE 'legal' END, '"',
               CASE WHEN p_brand < 'Brand#2' THEN ', "pauper": "legal"' ELSE '' END, '}}')"""
        ).alias("card"),
    )


def parsed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = C.split_corrupt(parse_export(card_objects(spark, sf_dir)))
    return C.parse_cards(good)


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as landed search pages: a conversation is a sweep, its turns are the
    pages and the lines of a turn the entries; landed as JSON and read like any landing."""
    rendered = table(spark, sf_dir, "conversations").select(
        F.to_json(
            F.struct(
                F.col("conv_id").cast("string").alias("card_name"),
                F.lit("modern").alias("format"),
                F.when(F.col("role") == "user", "full").otherwise("incremental").alias("mode"),
                (F.col("turn") + 1).alias("page"),
                F.col("conv_id").alias("seq"),
                F.expr(
                    r"""transform(split(text, '\n'), line -> named_struct(
                        'publicId', CASE WHEN length(line) > 60 THEN md5(line) ELSE '' END,
                        'id', CASE WHEN length(line) > 20 THEN concat('id-', md5(line)) END,
                        'name', line,
                        'format', CASE WHEN line LIKE 'L%' THEN 'pauper' WHEN line LIKE 'E%' THEN 'brawl' ELSE '' END,
                        'createdByUser', named_struct('userName', CASE WHEN line LIKE '%.' THEN concat(role, ' ', turn) END),
                        'authorUserName', role,
                        'colorIdentity', CASE WHEN line LIKE '%,%' THEN array() ELSE split(line, '') END,
                        'colors', array('R', 'g '),
                        'createdAtUtc', concat('2024-01-', lpad(turn + 1, 2, '0'), 'T00:00:00Z'),
                        'lastUpdatedAtUtc', CASE WHEN line LIKE '%.' THEN concat('2024-02-', lpad(turn + 1, 2, '0'), 'T01:00:00+01:00') ELSE 'never' END))"""
                ).alias("data"),
            )
        ).alias("json")
    )
    return read_pages(spark, landed(spark, sf_dir, "pages", rendered))


def order_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as stubs: a customer's orders of one priority are one deck."""
    stamp = F.expr("CASE WHEN o_orderstatus <> 'P' THEN timestamp_micros(CAST(o_totalprice AS BIGINT) * 1000000) END")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("format"),
        F.col("o_custkey").cast("string").alias("moxfield_id"),
        F.col("o_orderstatus").alias("name"),
        F.lit(None).cast("string").alias("author"),
        F.lit(0).alias("color_mask"),
        stamp.alias("created_at_utc"),
        stamp.alias("updated_at_utc"),
        F.col("o_orderdate").alias("scraped_at"),
        F.col("o_orderkey").alias("seq"),
        F.lit(0).alias("pos"),
    )


def stored_orders(folded: DataFrame) -> DataFrame:
    """Folded stubs as decks in several states."""
    status = F.expr("CASE name WHEN 'F' THEN 'done' WHEN 'O' THEN 'claimed' ELSE 'error' END")
    return folded.select(
        *stubs.KEY, "name", "author", "color_mask", "created_at_utc", "updated_at_utc", "scraped_at",
        status.alias("status"),
    )


def merged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_stubs(spark, sf_dir)
    before, after = rows.filter(f"scraped_at < {CUT}"), rows.filter(f"scraped_at >= {CUT}")
    return stubs.upsert_stubs(stored_orders(stubs.fold_stubs(before)), stubs.fold_stubs(after))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as sweep units."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("card_id"),
        F.col("o_orderpriority").alias("format"),
        (F.col("o_orderstatus") == "O").alias("swept"),
        (F.col("o_totalprice") > 100000).alias("ever_swept"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("claimed_at"),
        F.lit(None).cast("string").alias("claimed_by"),
    )


def order_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as decks waiting to be fetched."""
    return table(spark, sf_dir, "orders").select(
        F.expr(
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'legacy' WHEN '2-HIGH' THEN 'modern' "
            "WHEN '3-MEDIUM' THEN 'pauper' WHEN '4-NOT SPECIFIED' THEN 'highlanderCanadian' ELSE 'vintage' END"
        ).alias("format"),
        F.col("o_orderkey").cast("string").alias("moxfield_id"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'discovered' ELSE 'claimed' END").alias("status"),
        F.col("o_orderdate").alias("scraped_at"),
        F.col("o_orderdate").alias("claimed_at"),
        F.concat(F.lit("c"), "o_custkey").alias("claimed_by"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a deck event log; the tens of ``k`` split a user's events into decks."""
    kinds = {"view": "discover", "signup": "discover", "click": "claim", "purchase": "ok", "error": "err"}
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.floor(k / 10).cast("int").alias("tens"),
        F.col("event_id").alias("seq"),
        lifecycle.event_kind(kinds, F.col("event_type")).alias("kind"),
        F.when(k >= 15, F.col("value")).alias("updated_at"),
        F.col("value").alias("created_at"),
        "ts",
    )


# --- cards -----------------------------------------------------------------------------------


def card_parse(spark, sf_dir):
    parsed = parsed_cards(spark, sf_dir)
    return parsed.select(
        *[F.col(c).cast("int").alias(c) if c in ("reserved", "textless", "game_changer") else F.col(c)
          for c in parsed.columns if c not in ("cmc", "ordinal")],
        F.col("cmc").cast("double").alias("cmc"),
        S.search_name(F.col("card_name")).alias("search_name"),
    )


def first_card_of_name(spark, sf_dir):
    return C.first_of_name(parsed_cards(spark, sf_dir)).select("card_name", "scryfall_id", "layout")


def dedupe_first_wins(spark, sf_dir):
    docs = digested(spark, sf_dir)
    return first_per_key(docs, ["digest"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


def collision_count(spark, sf_dir):
    docs = C.count_collisions(digested(spark, sf_dir), "digest")
    parts = C.count_collisions(parsed_cards(spark, sf_dir))
    return docs.select(F.lit("documents").alias("source"), "collisions").unionByName(
        parts.select(F.lit("part").alias("source"), "collisions")
    )


def color_masks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        S.color_mask(F.split("p_name", "")).alias("name_mask"),
        S.color_mask_text(F.array_join(F.split("p_type", ""), " , ")).alias("type_mask"),
    )


def color_mask_rows(spark, sf_dir):
    letters = table(spark, sf_dir, "customer").select("c_nationkey", F.explode(F.split("c_mktsegment", "")).alias("x"))
    return letters.groupBy("c_nationkey").agg(F.bit_or(S.color_bit(F.col("x"))).alias("mask"))


def format_fanout(spark, sf_dir):
    return C.eligible_formats(parsed_cards(spark, sf_dir), "ordinal")


def format_stats(spark, sf_dir):
    fanned = C.eligible_formats(parsed_cards(spark, sf_dir), "ordinal")
    return stats.rows_per(fanned)


def card_total(spark, sf_dir):
    return stats.total_cards(parsed_cards(spark, sf_dir))


def status_extension(spark, sf_dir):
    """Formats still missing for all cards, when those of 'legal in commander' cards exist."""
    cards = parsed_cards(spark, sf_dir).withColumn("id", F.col("ordinal"))
    stored = C.eligible_formats(cards.filter("legal_commander = 'legal'")).select(
        "card_id", "format", F.lit(True).alias("swept"), F.lit(True).alias("ever_swept"),
        F.lit(None).cast("timestamp").alias("claimed_at"), F.lit("w").alias("claimed_by"),
    )
    return C.extend_status(stored, cards).groupBy("format").agg(
        F.count("*").alias("units"), F.count_if("ever_swept").alias("swept_units")
    )


def incoming_vocabulary(spark, sf_dir):
    seen = words(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id").filter("w <> ''")
    return seen.groupBy(F.col("w").alias("card_name")).agg(
        F.min(F.shiftleft("doc_id", 32) + F.col("pos")).alias("ordinal"), F.count("*").alias("seen")
    )


def insert_anti(spark, sf_dir):
    return C.new_names(vocabulary(spark, sf_dir), incoming_vocabulary(spark, sf_dir)).select("card_name", "seen")


def dimension_upsert(spark, sf_dir):
    return C.upsert_cards(vocabulary(spark, sf_dir), incoming_vocabulary(spark, sf_dir))


def upsert_change_counts(spark, sf_dir):
    return C.count_changes(C.mark_changes(vocabulary(spark, sf_dir), incoming_vocabulary(spark, sf_dir)))


# --- resolution ------------------------------------------------------------------------------


def card_usage(spark, sf_dir):
    return C.card_usage(deck_entries(spark, sf_dir), vocabulary(spark, sf_dir), ["format"]).filter("card_id IS NOT NULL")


def name_resolve(spark, sf_dir):
    """Orders' parts resolved to names: per brand, lines and pieces."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("card_id"), "l_quantity")
    per_part = lines.groupBy("card_id").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("card_name"))
    return C.names_of(per_part, parts).groupBy(F.col("card_name").alias("brand")).agg(
        F.sum("n").alias("lines"), F.sum("q").alias("pieces")
    )


def unresolved_names(spark, sf_dir):
    resolved = C.resolve_names(deck_entries(spark, sf_dir), vocabulary(spark, sf_dir))
    return resolved.filter("card_id IS NULL").groupBy("format", "moxfield_id", "card_name").agg(
        F.count("*").alias("times")
    )


# --- discovery -------------------------------------------------------------------------------


def stub_parse(spark, sf_dir):
    known, _ = stubs.split_formats(stubs.parse_stubs(search_pages(spark, sf_dir)))
    return known.select(
        "moxfield_id", "name", "format", "author", "color_mask", "sweep_card", "page", "pos",
        F.unix_seconds("created_at_utc").alias("created_s"), F.unix_seconds("updated_at_utc").alias("updated_s"),
    )


def unknown_formats(spark, sf_dir):
    return stubs.unknown_formats(stubs.parse_stubs(search_pages(spark, sf_dir)))


def stub_upsert(spark, sf_dir):
    return merged_orders(spark, sf_dir).select(
        *stubs.KEY, "name", "status", "is_new", "requeued", "n_stubs",
        F.unix_seconds("created_at_utc").alias("created_s"), F.unix_seconds("updated_at_utc").alias("updated_s"),
    )


def stub_upsert_counts(spark, sf_dir):
    return stubs.count_upserts(merged_orders(spark, sf_dir))


def cut_document_pages(spark, sf_dir):
    """``documents`` as sweeps: lines are pages, words the decks found on them."""
    lines = texts(spark, sf_dir, "documents", "doc_id", "lang", "text").select(
        "doc_id",
        F.when(F.col("lang") == "en", "incremental").otherwise("full").alias("mode"),
        F.size(F.split("text", "\n")).alias("total_pages"),
        F.posexplode(F.split("text", "\n")).alias("at", "line"),
    ).withColumn("page", F.col("at") + 1).withColumn("ids", F.expr("filter(split(line, ' '), w -> w <> '')"))
    found = lines.select("doc_id", "page", F.explode("ids").alias("card_name"))
    pages = lines.select("doc_id", "page", "mode", "total_pages", F.size("ids").alias("raw_count"))
    known = vocabulary(spark, sf_dir).select("card_name")
    fresh = paging.new_per_page(found, known, ["doc_id"], ["card_name"])
    return paging.cut_pages(pages, fresh, ["doc_id"], page_size=3)


def early_exit_pages(spark, sf_dir):
    return cut_document_pages(spark, sf_dir).pages.select("doc_id", "page", "raw_count", "new_decks")


def sweep_totals(spark, sf_dir):
    return cut_document_pages(spark, sf_dir).sweeps


# --- submission ------------------------------------------------------------------------------


def deck_flatten(spark, sf_dir):
    flat = submissions.flatten_decks(deck_documents(spark, sf_dir))
    return flat.groupBy("format", "moxfield_id", "board").agg(
        F.count("*").alias("entries"), F.sum("quantity").alias("copies"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min_by("card_name", "pos").alias("first_name"), F.max_by("card_name", "pos").alias("last_name"),
    )


def submitted_documents(spark, sf_dir):
    return submissions.submission_rows(deck_documents(spark, sf_dir), vocabulary(spark, sf_dir))


def as_texts() -> list[Column]:
    """Contents of singleton decks, written out as text."""
    return [
        F.array_join("card_ids", ",").alias("card_ids"),
        F.array_join(F.coalesce("commander_ids", F.array().cast("array<int>")), ",").alias("commander_ids"),
        F.md5(F.array_join("unresolved", "|")).alias("unresolved_md5"),
    ]


def array_pack(spark, sf_dir):
    """Singleton decks as arrays, written out as text."""
    rows = submitted_documents(spark, sf_dir).filter("card_ids IS NOT NULL")
    return rows.select("format", "moxfield_id", "n_rows", *as_texts())


def bridge_of_documents(spark, sf_dir):
    """Regular decks as bridge rows: the last quantity per card and board."""
    rows = submitted_documents(spark, sf_dir).filter("bridge IS NOT NULL")
    return rows.select("format", "moxfield_id", F.explode("bridge").alias("e")).select(
        "format", "moxfield_id", "e.card_id", "e.board", "e.quantity"
    )


def names_resolved_later(spark, sf_dir):
    """Decks packed while only cards with long names were known, and packed again with all of them: as if submitted then."""
    cards = vocabulary(spark, sf_dir)
    early = submissions.submission_rows(deck_documents(spark, sf_dir), cards.filter("length(card_name) > 5"))
    contents = [*submissions.KEY, F.size("card_ids").alias("n_rows"), F.col("card_ids").isNotNull().alias("singleton"), *as_texts()]
    early = stored(early.select(*contents, "open"), scratch(spark, "early"))
    again = submissions.resolve_open(early.filter("open IS NOT NULL").select(*submissions.KEY, "open"), cards)
    again = stored(again.select(*contents), scratch(spark, "again"))
    as_before = early.drop("open").join(again.select(*submissions.KEY), submissions.KEY, "left_anti")
    return as_before.unionByName(again).filter("singleton").drop("singleton")


def bridge_replace(spark, sf_dir):
    """Lines shipped later replace all earlier lines of their order."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("moxfield_id"), F.col("l_partkey").alias("card_id"),
        F.col("l_linestatus").alias("board"), F.col("l_quantity").alias("quantity"),
        "l_shipdate", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    )
    key, order = ["moxfield_id", "card_id", "board"], [
        "l_shipdate", "l_linenumber", "l_suppkey", "quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    ]
    stored = submissions.last_quantity(lines.filter(f"l_shipdate < {CUT}"), key, order)
    later = submissions.last_quantity(lines.filter(f"l_shipdate >= {CUT}"), key, order)
    return submissions.replace_bridge(stored, later, later, ["moxfield_id"])


def conversation_submissions(spark, sf_dir):
    """``conversations`` as submissions: every turn submits the conversation's deck again."""
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("modern").alias("format"), F.col("conv_id").cast("string").alias("moxfield_id"),
        F.col("turn").alias("seq"), F.lit(None).cast("timestamp").alias("fetched_at"),
        (F.col("role") == "user").alias("error"), "text",
    )
    entries = words(turns.filter("NOT error"), "format", "moxfield_id", "seq").select(
        "format", "moxfield_id", "seq", "pos", F.expr(BOARD).alias("board"),
        F.col("w").alias("card_name"), (F.length("w") - 4).alias("quantity"),
    ).filter("card_name <> ''")
    packed = submissions.pack_documents(C.resolve_names(entries, vocabulary(spark, sf_dir)))
    empty = F.array().cast("array<string>")
    return turns.drop("text").join(packed, submissions.DOCUMENT, "left").select(
        *submissions.DOCUMENT, "fetched_at", "error", "card_ids", "commander_ids", "bridge",
        F.coalesce("unresolved", empty).alias("unresolved"),
        F.when(F.col("bridge").isNotNull(), F.size("bridge")).otherwise(0).alias("n_rows"),
    )


def label_decks(spark, sf_dir):
    """``labels`` as stored decks."""
    return table(spark, sf_dir, "labels").select(
        F.lit("modern").alias("format"), F.col("doc_id").cast("string").alias("moxfield_id"),
        F.expr("CASE WHEN toxic = 1 THEN 'done' WHEN quality = 1 THEN 'claimed' ELSE 'discovered' END").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("cards_fetched_at"),
        F.lit(None).cast("array<int>").alias("card_ids"), F.lit(None).cast("array<int>").alias("commander_ids"),
    )


def judged_conversations(spark, sf_dir):
    submitted, decks = conversation_submissions(spark, sf_dir), label_decks(spark, sf_dir)
    changes = submissions.deck_changes(decks, submitted)
    return decks, changes, submissions.judge(submitted, changes)


def outcome_table(spark, sf_dir):
    _, _, judged = judged_conversations(spark, sf_dir)
    return submissions.outcome_table(judged).select(
        "moxfield_id", "seq", "written", F.size("unresolved").alias("n_unresolved"), "collision", "errored"
    )


def outcome_counts(spark, sf_dir):
    return submissions.count_outcomes(judged_conversations(spark, sf_dir)[2])


def settled_decks(spark, sf_dir):
    decks, changes, judged = judged_conversations(spark, sf_dir)
    return submissions.settle_decks(decks, changes, judged, F.expr(AS_OF)).select(
        "moxfield_id", "status", "cards_fetched_at"
    )


def attempt_verdict(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')").select(
        "user_id", F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int").alias("tens"),
        F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"),
    )
    return submissions.fetch_verdicts(attempts, ["user_id", "tens"])


def attempt_stream(spark, sf_dir):
    """Failed and successful fetches in four batches: reports per deck, and the failures that still wait."""
    key = ["user_id", "tens"]
    attempts = table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')").select(
        "user_id", F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int").alias("tens"),
        F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("error"),
    )
    root = scratch(spark, "attempts")
    in_parts(attempts, "seq", 4, f"{root}/in")
    counts = KeyedTable(spark, f"{root}/counts", "user_id bigint, tens int, failures int", tuple(key), 16)
    for part in range(4):
        batch = spark.read.parquet(f"{root}/in/part={part}")
        touched = counts.touched(batch)
        state = counts.read(buckets=touched)
        done = submissions.attempt_reports(batch, state, key, chunk_bits=10)
        done.reports.write.parquet(f"{root}/reports/part={part}")
        counts.write(state.join(done.state, key, "left_anti").unionByName(done.state), part + 1, buckets=touched)
    reports = spark.read.parquet(f"{root}/reports").groupBy(*key).agg(
        F.count_if(~F.col("error")).alias("ok"), F.count_if("error").alias("errors")
    )
    return counts.read().join(reports, key, "left").select(
        *key, F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("errors", F.lit(0)).alias("errors"), "failures"
    )


# --- work lists ------------------------------------------------------------------------------


def sweep_worklist(spark, sf_dir):
    rows = worklist.next_sweeps(units(spark, sf_dir), F.expr("timestamp_ntz'1999-01-01 00:00:00'"), 50)
    return rows.select("card_id", "format", "claimed_at", S.sweep_mode(F.col("ever_swept")).alias("mode"))


def added_column(spark, sf_dir):
    """Units written before ``ever_swept`` existed, read with it: all are to be swept in full."""
    folder = f"{scratch(spark, 'units')}/status"
    old = CARD_FORMAT_STATUS.replace("ever_swept boolean, ", "")
    rows = units(spark, sf_dir).withColumns({"card_id": F.col("card_id").cast("int"), "claimed_at": F.col("claimed_at").cast("timestamp")})
    SnapshotTable(spark, folder, old).write(rows.drop("ever_swept"), 1)
    now = SnapshotTable(spark, folder, CARD_FORMAT_STATUS, defaults=STATUS_DEFAULTS).read()
    chosen = worklist.next_sweeps(now, F.expr("timestamp_ntz'1999-01-01 00:00:00'").cast("timestamp"), 50)
    return chosen.select("card_id", "format", F.col("claimed_at").cast("timestamp_ntz").alias("claimed_at"), "ever_swept",
                         S.sweep_mode(F.col("ever_swept")).alias("mode"))


def deck_worklist(spark, sf_dir):
    return worklist.deck_worklist(order_decks(spark, sf_dir), F.expr(AS_OF), 50).select("format", "moxfield_id")


def batch_assignment(spark, sf_dir):
    return worklist.number_batches(order_decks(spark, sf_dir), F.expr("timestamp_ntz'1997-06-01 00:00:00'"), 50)


def lease_stamps(spark, sf_dir):
    decks, as_of = order_decks(spark, sf_dir), F.expr(AS_OF)
    claimed = worklist.deck_worklist(decks, as_of, 50)
    stamped = worklist.stamp_leases(decks, claimed, stubs.KEY, "worker", as_of)
    return stamped.groupBy("format", "status").agg(
        F.count("*").alias("decks"), F.count_if(F.col("claimed_by") == "worker").alias("stamped")
    )


def stale_leases(spark, sf_dir):
    """``click`` events as leases of their user."""
    leases = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "click", "claimed").otherwise("done").alias("status"),
        F.col("ts").alias("claimed_at"), F.col("user_id").alias("claimed_by"),
    )
    return worklist.stale_leases(leases, F.expr(AS_OF))


def queue_drained(spark, sf_dir):
    """Per customer as format: pending orders, and whether none is left."""
    decks = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("format"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_totalprice") < 250000, "error")
        .when(F.col("o_orderstatus") == "O", "discovered").otherwise("claimed").alias("status"),
    )
    return worklist.drained_formats(decks)


def sweep_completion(spark, sf_dir):
    """Units completed by delivered lines, and what is then left per format."""
    delivered = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select("l_orderkey").distinct()
    done = table(spark, sf_dir, "orders").join(delivered, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("card_id"), F.col("o_orderpriority").alias("format"))
    marked, _ = worklist.complete_sweeps(units(spark, sf_dir), done)
    return marked.groupBy("format").agg(
        F.count_if("swept").alias("swept"), F.count_if("ever_swept").alias("ever_swept"), F.count("*").alias("units")
    )


def lost_completions(spark, sf_dir):
    """Labels completing documents' units: those of a format the unit does not have."""
    held = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("card_id"), F.col("lang").alias("format"), F.lit(False).alias("swept"), F.lit(False).alias("ever_swept")
    )
    done = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("card_id"), F.when(F.col("quality") == 1, "en").otherwise("fr").alias("format")
    )
    _, lost = worklist.complete_sweeps(held, done)
    return lost


def order_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """``orders`` as decks found, some fetched (F) and some leased long ago (P), built from their logs."""
    root = scratch(spark, "orders")
    orders = order_decks(spark, sf_dir).withColumn("seq", F.col("moxfield_id").cast("long"))
    stub_log, submission_log = BatchLog(spark, f"{root}/stubs", STUB_LOG), BatchLog(spark, f"{root}/submissions", SUBMISSION_LOG)
    work_log = WorkLog(spark, f"{root}/work", WORK_LOG)
    no = F.lit(None)
    stub_log.put(
        orders.select(
            *stubs.KEY, F.col("scraped_at").cast("timestamp").alias("scraped_at"), "seq", F.lit(0).alias("pos"), F.lit(1).alias("page"),
            F.lit(0).alias("color_mask"), *[no.cast("string").alias(c) for c in ("name", "author", "sweep_card", "sweep_format")],
            *[no.cast("timestamp").alias(c) for c in ("created_at_utc", "updated_at_utc")],
        ),
        0,
    )
    submission_log.put(fetched_orders(orders.filter("status = 'done'")), 0)
    work_log.put(
        orders.filter("status = 'claimed'").select(
            F.lit("claim").alias("kind"), no.cast("int").alias("card_id"), *stubs.KEY, F.col("claimed_by").alias("holder"),
            F.col("claimed_at").cast("timestamp").alias("at"), F.lit("long ago").alias("request"),
            F.lit(1).cast("long").alias("stub_batches"), F.lit(1).cast("long").alias("submission_batches"),
        ),
        0,
    )
    corpus = Corpus(
        stub_log, submission_log, KeyedTable(spark, f"{root}/decks", DECKS, tuple(stubs.KEY), 16),
        KeyedTable(spark, f"{root}/deck_cards", DECK_CARDS, tuple(stubs.KEY), 16), SnapshotTable(spark, f"{root}/builds", BUILDS), work_log,
    )
    corpus.build()
    return corpus


def fetched_orders(orders: DataFrame) -> DataFrame:
    """Submissions without cards for all the given decks."""
    types = {f.name: f.dataType for f in StructType.fromDDL(SUBMISSION_LOG).fields if f.name != "batch"}
    known = {"error": F.lit(False), "n_rows": F.lit(0), "doc": F.lit(0), "stub_batches": F.lit(1), **{c: F.col(c) for c in (*stubs.KEY, "seq")}}
    return orders.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def minutes_later(minutes: int) -> Column:
    return F.expr(AS_OF).cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes))


def stored_claims(spark, sf_dir):
    """Decks leased three times with builds in between: the first leases run out and are given out again."""
    corpus = order_corpus(spark, sf_dir)
    work = Handout(units(spark, sf_dir), spark.createDataFrame([], "id int, card_name string"), corpus)
    work.decks(minutes_later(0), "first", "a", 50)
    work.decks(minutes_later(5), "nobody", "a", 50)  # a repeated request
    work.decks(minutes_later(10), "second", "b", 50)
    corpus.build()
    work.decks(minutes_later(31), "third", "c", 50)
    corpus.build()
    return corpus.decks.read().select(
        *stubs.KEY, "status", "claimed_by", F.col("claimed_at").cast("timestamp_ntz").alias("claimed_at")
    )


def cycle_reset(spark, sf_dir):
    """Sweep units as they are leased, then completed while decks wait, then after the turn of the cycle."""
    corpus = order_corpus(spark, sf_dir)
    status = units(spark, sf_dir).withColumns({"card_id": F.col("card_id").cast("int"), "claimed_at": F.col("claimed_at").cast("timestamp")})
    cards = status.select(F.col("card_id").alias("id"), F.col("card_id").cast("string").alias("card_name"))
    work, early = Handout(status, cards, corpus), F.expr("timestamp_ntz'1990-01-01 00:00:00'").cast("timestamp")

    def seen(phase: str) -> DataFrame:
        return work.units().groupBy("format").agg(
            F.count_if("swept").alias("swept"), F.count_if("ever_swept").alias("ever_swept"),
            F.count_if(F.col("claimed_by") == "worker").alias("leased"),
        ).select(F.lit(phase).alias("phase"), "*").checkpoint()

    work.sweeps(early, 50, "worker", "a")
    phases = seen("leased")
    open_units = status.filter("NOT swept AND claimed_at IS NULL").select(F.col("card_id").cast("string").alias("card_name"), "format")
    work.complete(open_units, "worker", early, "done")
    work.sweeps(early, 50, "worker", "b")  # nothing is left, but decks are waiting
    phases = phases.unionByName(seen("completed"))
    waiting = order_decks(spark, sf_dir).withColumn("seq", F.col("moxfield_id").cast("long")).filter("status <> 'done'")
    corpus.submission_log.put(fetched_orders(waiting), 1)
    corpus.build()
    work.sweeps(early, 50, "worker", "c")
    return phases.unionByName(seen("turned"))


# --- life cycle, quality, streams ------------------------------------------------------------


def lifecycle_state(spark, sf_dir):
    states = lifecycle.deck_states(event_log(spark, sf_dir), ["user_id", "tens"])
    return states.select("user_id", "tens", "status", "updated_at", "created_at", "cards_fetched_at")


def constraint_report(spark, sf_dir):
    orders, lines, customers, parts = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "part"))
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.report(
        [
            quality.duplicate_keys("orders key", orders, ["o_orderkey"]),
            quality.duplicate_keys("lineitem key", lines, ["l_orderkey", "l_linenumber"]),
            quality.duplicate_keys("part name", parts, ["p_name"]),
            quality.duplicate_keys("document text", digested(spark, sf_dir), ["digest"]),
            quality.nulls_in("customer required", customers, ["c_name", "c_acctbal"]),
            quality.not_in("order status", orders, "o_orderstatus", ("F", "O")),
            quality.orphans("line has order", lines, ["l_orderkey"], orders, ["o_orderkey"]),
            quality.orphans("order has line", orders, ["o_orderkey"], lines.select("l_orderkey").distinct(), ["l_orderkey"]),
            quality.orphans("document has label", docs, ["doc_id"], labels, ["doc_id"]),
        ]
    )


def cascade_delete(spark, sf_dir):
    """Orders of customers in debt are deleted with their lines."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    debt = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    deleted = orders.join(debt, "o_custkey", "left_semi")
    left, rest = quality.delete_with_children(orders, lines, deleted, ["o_orderkey"], ["l_orderkey"])
    totals = left.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit("orders").alias("t"), "*")
    lost = rest.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys")).select(F.lit("lineitem").alias("t"), "*")
    return totals.unionByName(lost)


def event_stubs(events: DataFrame) -> DataFrame:
    """``events`` as stubs of their user's decks, told apart by ``k``."""
    stamp = order_stamp(F.col("value"))
    empty = F.lit(None).cast("string")
    return events.select(
        F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")).alias("moxfield_id"), F.col("event_type").alias("name"),
        F.lit("modern").alias("format"), F.col("props").alias("author"), F.lit(0).alias("color_mask"),
        stamp.alias("created_at_utc"), F.when(F.col("event_type") != "error", stamp).alias("updated_at_utc"),
        F.timestamp_micros("event_id").alias("scraped_at"),
        empty.alias("sweep_card"), empty.alias("sweep_format"), F.lit(1).alias("page"),
        F.col("event_id").alias("seq"), F.lit(0).alias("pos"),
    )


def in_parts(df: DataFrame, key: str, parts: int, root: str) -> str:
    """The rows as files that land one after the other, by ranges of a whole-number key; all of them are landed."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = 1 if low is None else (high - low) // parts + 1
    for k in range(parts):
        part = df.filter(F.expr(f"({key} - {low or 0}) DIV {width} = {k}"))
        part.coalesce(1).write.mode("overwrite").parquet(f"{root}/part={k}")
    return f"{root}/part=*"


def order_stamp(value: Column) -> Column:
    return F.timestamp_micros((value * 100).cast("long") * 1000000)


def stream_upsert(spark, sf_dir):
    """``events`` streamed in four micro-batches as stubs into decks that were fetched before (those of ``orders``)."""
    root = scratch(spark, "stream")
    events = table(spark, sf_dir, "events")
    folder = in_parts(events.select("event_id", "user_id", "event_type", "value", "props"), "event_id", 4, f"{root}/in")
    decks = KeyedTable(spark, f"{root}/decks", DECKS, tuple(stubs.KEY), 16)
    names = StructType.fromDDL(DECKS).fields
    fetched = table(spark, sf_dir, "orders").groupBy(
        F.concat_ws("-", "o_custkey", (F.col("o_orderkey") % 100).cast("string")).alias("moxfield_id")
    ).agg(order_stamp(F.max("o_totalprice") / 5000).alias("stamp"))
    known = {"moxfield_id": F.col("moxfield_id"), "format": F.lit("modern"), "status": F.lit("done"),
             "created_at_utc": F.col("stamp"), "updated_at_utc": F.col("stamp")}
    decks.write(fetched.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in names]), 0)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sink = StubSink(decks, BatchLog(spark, f"{root}/log", STUB_LOG), f"{root}/broken")
    start_stubs(event_stubs(stream), sink, f"{root}/checkpoint").awaitTermination()
    return decks.read().select(
        "moxfield_id", "name", "author", "status",
        F.unix_seconds("created_at_utc").alias("created_s"), F.unix_seconds("updated_at_utc").alias("updated_s"),
    )


def stream_lifecycle(spark, sf_dir):
    """``events`` in four micro-batches through the stateful life cycle; states are those of the whole log."""
    root = scratch(spark, "states")
    log = event_log(spark, sf_dir).filter("kind IS NOT NULL").select(
        "user_id", "tens", "seq", "kind", "updated_at", "created_at",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.concat(F.lit("w"), "user_id").alias("holder"),
    )
    folder = in_parts(log, "seq", 4, f"{root}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    states = KeyedTable(spark, f"{root}/states", f"user_id bigint, tens int, {STATE}", ("user_id", "tens"), 16)
    start_states(keep_states(stream, ["user_id", "tens"]), states, f"{root}/checkpoint").awaitTermination()
    return states.read().select(
        "user_id", "tens", "status", "updated_at", "created_at", "epoch",
        F.timestamp_micros("cards_fetched_us").cast("timestamp_ntz").alias("cards_fetched_at"),
    )


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The frame as written to a folder: like a checkpoint, but packed, and read by column."""
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can reach."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def seeded_status(spark, sf_dir):
    """``part`` seeded into an empty corpus: the tracked units with the ids given out."""
    root = scratch(spark, "seed")
    cards = SnapshotTable(spark, f"{root}/cards", CARDS)
    status = SnapshotTable(spark, f"{root}/status", CARD_FORMAT_STATUS)
    parse_export(card_objects(spark, sf_dir)).write.parquet(f"{root}/landed")
    seed_cards(spark.read.parquet(f"{root}/landed"), cards, status, 1)
    return C.names_of(status.read(), cards.read()).select("card_id", "card_name", "format", "swept")


def unknown_log(spark, sf_dir):
    """Words without a card, appended to the text log and read back."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "lang", "text").withColumn(
        "text", F.translate("text", "\n\t\r", "   ")
    )
    entries = words(docs.withColumn("format", F.expr(DECK_FORMAT)), "format", "doc_id").filter("w <> ''").select(
        F.lit(None).cast("timestamp").alias("ts"), "format", F.col("doc_id").cast("string").alias("moxfield_id"),
        F.col("w").alias("card_name"),
    )
    lost = C.resolve_names(entries, vocabulary(spark, sf_dir)).filter("card_id IS NULL").drop("card_id")
    folder = scratch(spark, "unknown")
    append_unknown(lost.withColumn("ts", F.current_timestamp()), folder)
    return read_unknown(spark, folder).filter("ts IS NOT NULL").groupBy("format").agg(
        F.count("*").alias("lines"), F.count_distinct("card_name").alias("names")
    )


def stream_corpus(spark, sf_dir):
    """All ``documents`` as found decks and, in several micro-batches, as their submissions; labelled ones change later."""
    root = scratch(spark, "corpus")
    cards = SnapshotTable(spark, f"{root}/cards", "id int, card_name string")
    cards.write(vocabulary(spark, sf_dir), 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(DECK_FORMAT).alias("format"))

    def found(rows: DataFrame, stamp: Column) -> DataFrame:
        return rows.select(
            "format", F.col("doc_id").cast("string").alias("moxfield_id"), (F.col("doc_id") - 1).alias("seq"), F.lit(0).alias("pos"),
            F.current_timestamp().alias("scraped_at"), F.lit(0).alias("color_mask"), F.lit(1).alias("page"), stamp.alias("updated_at_utc"),
            *[F.lit(None).cast(t).alias(c) for c, t in (
                ("name", "string"), ("author", "string"), ("created_at_utc", "timestamp"), ("sweep_card", "string"), ("sweep_format", "string"))],
        )

    stub_log = BatchLog(spark, f"{root}/stubs", STUB_LOG)
    stub_log.put(found(docs, F.lit(None).cast("timestamp")), 0)
    corpus = Corpus(
        stub_log,
        BatchLog(spark, f"{root}/submissions", SUBMISSION_LOG),
        KeyedTable(spark, f"{root}/decks", DECKS, tuple(stubs.KEY), 16),
        KeyedTable(spark, f"{root}/deck_cards", DECK_CARDS, tuple(stubs.KEY), 16),
        SnapshotTable(spark, f"{root}/builds", BUILDS),
    )
    sink = SubmissionSink(cards, corpus, f"{root}/outcomes", f"{root}/unknown", f"{root}/broken")
    folder = land_documents(spark, sf_dir, "reports", F.col("n_chars") < 300)
    files = len(spark.read.text(folder).inputFiles())
    stream = read_details(spark, folder, stream=True, files_per_batch=max(1, -(-files // 3)))
    start_submissions(stream, sink, f"{root}/checkpoint").awaitTermination()
    corpus.build()
    changed = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    stub_log.put(found(changed, F.timestamp_seconds(F.lit(1))), 1)
    corpus.build()
    decks, rows = corpus.decks.read(), corpus.deck_cards.read()
    per_deck = rows.groupBy(*stubs.KEY).agg(F.count("*").alias("n_rows"))
    told = spark.read.parquet(f"{root}/outcomes").select(*stubs.KEY, "written", "errored")
    return decks.join(per_deck, stubs.KEY, "left").join(told, stubs.KEY, "left").select(
        *stubs.KEY, "status", F.array_size("card_ids").alias("n_cards"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.array_size(F.array_distinct("commander_ids")).alias("n_commanders"), "written", "errored",
    )


QUERIES = {
    f.__name__: f
    for f in (
        card_usage, card_parse, first_card_of_name, dedupe_first_wins, collision_count, color_masks, color_mask_rows,
        format_fanout, format_stats, card_total, status_extension, insert_anti, dimension_upsert,
        upsert_change_counts, name_resolve, unresolved_names, stub_parse, unknown_formats, stub_upsert,
        stub_upsert_counts, early_exit_pages, sweep_totals, deck_flatten, array_pack, bridge_of_documents, names_resolved_later,
        bridge_replace, outcome_table, outcome_counts, settled_decks, attempt_verdict, sweep_worklist,
        deck_worklist, batch_assignment, lease_stamps, stale_leases, queue_drained, sweep_completion,
        lost_completions, cycle_reset, lifecycle_state, constraint_report, cascade_delete, stream_upsert,
        seeded_status, unknown_log, stream_corpus, stored_claims, stream_lifecycle, attempt_stream, added_column,
    )
}
