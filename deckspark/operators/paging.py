"""Where a sweep over search pages would have stopped reading."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckspark.functions.formats import PAGE_SIZE
from deckspark.operators.skew import lookup_join
from deckspark.session import shared_dir

SWEEP = ["sweep_card", "sweep_format"]


class CutPages(NamedTuple):
    pages: DataFrame
    sweeps: DataFrame
    ends: DataFrame


def page_facts(landed: DataFrame, *keep: str) -> DataFrame:
    """One row per landed page, without its entries."""
    return landed.select(
        *keep,
        F.col("card_name").alias("sweep_card"),
        F.col("format").alias("sweep_format"),
        "mode",
        "page",
        F.coalesce("totalPages", F.lit(1)).alias("total_pages"),
        F.coalesce(F.when(F.col("data").isNotNull(), F.size("data")), F.lit(0)).alias("raw_count"),
    )


def new_per_page(
    stubs: DataFrame, known: DataFrame, sweep: list[str] = SWEEP, key: list[str] | None = None
) -> DataFrame:
    """Decks that are unknown and turn up for the first time in their sweep, per page."""
    key = key or ["format", "moxfield_id"]
    first_seen = stubs.groupBy(*sweep, *key).agg(F.min("page").alias("page"))
    unseen = first_seen.join(known.select(*key), key, "left_anti")
    return unseen.groupBy(*sweep, "page").agg(F.count("*").alias("new_decks"))


def cut_pages(
    pages: DataFrame,
    new_decks: DataFrame,
    sweep: list[str] = SWEEP,
    page_size: int = PAGE_SIZE,
) -> CutPages:
    """Keep each sweep's pages up to its first stopping page.

    A sweep stops at its last page, at a short or empty page and, when
    incremental, at a page without a new deck. As "no earlier page stopped" is
    the same as "not after the least stopping page", this takes a minimum per
    sweep and no window: a sweep of any length is combined before the exchange.
    The facts per page are checkpointed, as counting new decks went over all
    entries and is not to be repeated.
    """
    shared_dir(pages.sparkSession)
    facts = pages.join(new_decks, [*sweep, "page"], "left").withColumn(
        "new_decks", F.coalesce("new_decks", F.lit(0)).cast("long")
    ).checkpoint()
    stops = (
        (F.col("page") >= F.col("total_pages"))
        | (F.col("raw_count") < page_size)
        | ((F.col("mode") == "incremental") & (F.col("new_decks") == 0))
    )
    ends = facts.groupBy(*sweep).agg(F.min(F.when(stops, F.col("page"))).alias("last_page"))
    kept = lookup_join(facts, ends, sweep, "inner").filter(
        F.col("last_page").isNull() | (F.col("page") <= F.col("last_page"))
    )
    sweeps = kept.groupBy(*sweep).agg(
        F.sum("new_decks").alias("new_decks"),
        F.max("page").alias("pages"),
        F.max("last_page").isNotNull().alias("complete"),
    )
    return CutPages(kept.filter("raw_count > 0"), sweeps, ends)


def number_runs(facts: DataFrame, state: DataFrame) -> DataFrame:
    """Pages with the number of their sweep's run: each first page starts a new one.

    ``state`` holds each sweep's present ``run``. Pages are in the order of their landing number.
    """
    so_far = Window.partitionBy(*SWEEP).orderBy("seq", "page")
    known = state.select(*SWEEP, F.col("run").alias("_run"))
    started = F.sum(F.when(F.col("page") == 1, 1).otherwise(0)).over(so_far)
    return facts.join(known, SWEEP, "left").withColumn("run", F.coalesce("_run", F.lit(0)) + started).drop("_run")


class StreamCut(NamedTuple):
    kept: DataFrame
    state: DataFrame
    finished: DataFrame


def cut_landed(landed: DataFrame, stubs: DataFrame, known: DataFrame, state: DataFrame) -> StreamCut:
    """``cut_pages`` for pages that arrive over several batches.

    ``state`` (``SWEEP_STATE``) tells where each sweep's present run has ended, if it has; pages behind that are
    dropped whenever they arrive. ``known`` are the decks stored before the batch, so those of a run's earlier
    batches are no news. A page that lands twice counts once. ``kept`` are (sweep, seq, page) of the pages to
    read, ``state`` the sweeps of the batch as they are now, ``finished`` those that came to their end in it.
    """
    facts = page_facts(landed, "seq")
    runs = number_runs(facts, state)
    key = [*SWEEP, "run"]
    shared_dir(landed.sparkSession)
    marked = runs.join(
        state.select(*key, F.col("last_page").alias("_ended")), key, "left"
    ).checkpoint()
    of_stub = marked.select(*key, "seq", "page").distinct()
    found = stubs.join(of_stub, [*SWEEP, "seq", "page"])
    open_pages = marked.filter("_ended IS NULL OR page <= _ended").groupBy(*key, "page").agg(
        F.min("mode").alias("mode"), F.max("total_pages").alias("total_pages"), F.max("raw_count").alias("raw_count")
    )
    cut = cut_pages(open_pages, new_per_page(found, known, key), key)
    ends = cut.ends.select(*key, F.col("last_page").alias("_now"))
    kept = marked.join(ends, key, "left").filter(
        "(_ended IS NULL OR page <= _ended) AND (_now IS NULL OR page <= _now)"
    ).select(*SWEEP, "seq", "page").distinct()
    ended = marked.groupBy(*key).agg(F.max("_ended").alias("_ended")).join(ends, key, "left")
    after = ended.select(
        *SWEEP, "run", F.least("_ended", "_now").alias("last_page"), (F.col("_ended").isNull() & F.col("_now").isNotNull()).alias("_new")
    ).checkpoint()
    last = after.groupBy(*SWEEP).agg(F.max_by(F.struct("run", "last_page"), "run").alias("s")).select(*SWEEP, "s.run", "s.last_page")
    finished = after.filter("_new").select(F.col("sweep_card").alias("card_name"), F.col("sweep_format").alias("format")).distinct()
    return StreamCut(kept, last, finished)


def stubs_on(stubs: DataFrame, pages: DataFrame, sweep: list[str] = SWEEP) -> DataFrame:
    """The stubs found on the given pages."""
    return stubs.join(pages.select(*sweep, "page"), [*sweep, "page"], "left_semi")
