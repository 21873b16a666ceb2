"""Mixing sources to target weights by a low-discrepancy schedule, on built-in expressions.

Each source lays its documents, shuffled by a keyed hash, on a line of words and cuts
the line into blocks of equal length. The schedule is a row of slots: slot i has the
golden-ratio point frac(i * phi), the point falls into one source's share of the
cumulative weights, and the slot takes that source's next block. Any stretch of the
schedule therefore holds the sources in about their target proportions.

Defined cases: a null text has no words; a null source is a source of its own, the last;
documents without words are never taken; repeated rows are documents of their own;
an empty table gives no rows. Words are counted over whole texts. Runs agree as long as
the rows do, in whatever order and files they come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckspark.llm.common import cut, running_total
from deckspark.operators.skew import lookup_join

WORD = r"[^\x20\x09-\x0D]+"
#: floor(2^32 / phi): steps of the golden-ratio sequence in 32-bit fractions. Fixed value.
GOLDEN = 2654435769
#: Slots whose ranks are counted together.
CHUNK = 1 << 16
#: Equal cells of the unit interval by which points find their source.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), repeats: int = 2
) -> DataFrame:
    """One row per source: its size, weight and target.

    ``sizes`` has (source, size). The sources together are to give share[0]/share[1] times
    all words, by weight, but none more than ``repeats`` times its own: what is over goes
    to the others by weight. That level is found at once: in the order of limit over
    weight, the sources at their limit come first. Windows run over the table of
    sources, not over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (position + 1).cast("int")).cast("long")
    ).withColumn("limit", F.col("source_size") * repeats)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # Sums are whole numbers of words / share[1], so they are exact.
    wanted = F.sum("source_size").over(everything) * share[0]
    held = F.coalesce(F.sum("limit").over(before), F.lit(0)) * share[1]
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighed.withColumn("_rest", wanted - held).withColumn("_left", left)
    capped = levelled.withColumn(
        "_capped", F.col("limit") * share[1] * F.col("_left") <= F.col("_rest") * F.col("weight")
    )
    # The first source below its limit sets the level for all the others.
    rest = F.max(F.when(~F.col("_capped"), F.struct("_left", "_rest"))).over(everything)
    target = F.when(F.col("_capped"), F.col("limit").cast("double")).otherwise(
        rest["_rest"].cast("double") * F.col("weight") / (rest["_left"] * share[1])
    )
    return capped.select("source", "source_size", "weight", target.alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The slots (slot, source, rank): each source has as many as its target has blocks.

    A source that the points served a slot or two short gets the missing ones at the end.
    """
    spark = targets.sparkSession
    shares = cut(
        targets.withColumn("words", F.floor("target").cast("long"))
        .withColumn("slots", F.ceil(F.col("words") / block).cast("long"))
        .filter("slots > 0")
        .withColumn("_key", F.struct("source"))
    )
    total = shares.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ends = F.floor(F.sum("slots").over(by_name).cast("double") * (2.0**32) / max(1, total)).cast("long")
    spans = shares.withColumn("_to", ends).withColumn(
        "_from", F.coalesce(F.lag("_to").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0))
    )
    width = 2**32 // CELLS
    cells = spans.filter("_from < _to").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width)))
    )
    points = spark.range(total).select(
        F.col("id").alias("slot"),
        (F.col("id").bitwiseAND(0x7FFFFFFF) * GOLDEN).bitwiseAND(0xFFFFFFFF).alias("_point"),
    )
    served = points.withColumn("_cell", F.floor(F.col("_point") / width)).join(
        cells.select("_key", "slots", "_from", "_to", "_cell"), "_cell"
    ).filter("_point >= _from and _point < _to")
    # Ranks within a source: counts of the chunks before, then numbers inside the chunk.
    chunked = cut(served.select("slot", "_key", "slots", F.floor(F.col("slot") / CHUNK).alias("_chunk")))
    counts = chunked.groupBy("_key", "_chunk").count()
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.struct("_key", "_chunk").alias("_piece"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("_key", "_chunk").orderBy("slot")
    ranked = lookup_join(
        chunked.withColumn("_inside", F.row_number().over(inside) - 1).withColumn(
            "_piece", F.struct("_key", "_chunk")
        ),
        bases,
        ["_piece"],
        "inner",
    ).withColumn("rank", F.col("_inside") + F.col("_base"))
    drawn = ranked.filter("rank < slots").select("slot", "_key", "rank")
    got = counts.groupBy("_key").agg(F.sum("count").alias("_got"))
    short = (
        shares.join(got, "_key", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .filter("_got < slots")
        .withColumn("_more", F.col("slots") - F.col("_got"))
    )
    late = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    added = (
        short.withColumn("_start", F.lit(total) + F.coalesce(F.sum("_more").over(late), F.lit(0)))
        .withColumn("rank", F.explode(F.sequence(F.col("_got"), F.col("slots") - 1)))
        .select((F.col("_start") + F.col("rank") - F.col("_got")).alias("slot"), "_key", "rank")
    )
    return drawn.unionByName(added).select("slot", F.col("_key.source").alias("source"), "rank")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Narrow rows (id, doc_id, source, size) of all documents, from one scan of the texts.

    ``id`` numbers the rows of the stored frame; it does not decide anything.
    """
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep)
    return cut(narrow.withColumn("id", F.monotonically_increasing_id()))


def mix(
    rows: DataFrame,
    targets: DataFrame,
    block: int = 256,
    repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """Pieces of the mix: (slot, id, epoch, first_word, words), from ``measured`` rows.

    A source's line holds its documents in hashed order, once for each epoch. A piece is the part of a
    document that lies in one block; its slot says where in the mix the block comes.
    """
    shuffled = rows.withColumn("_mixed", F.md5(F.concat_ws(":", F.lit(seed), "doc_id").cast("binary")))
    laid = running_total(shuffled, ["source"], ["_mixed", "doc_id", "size", "id"], "size", "_start")
    placed = lookup_join(
        laid.withColumn("_key", F.struct("source")),
        targets.select(F.struct("source").alias("_key"), "source_size", F.floor("target").cast("long").alias("_end")),
        ["_key"],
        "inner",
    )
    lines = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    lines = lines.withColumn("_lo", F.col("epoch") * F.col("source_size") + F.col("_start")).withColumn(
        "_hi", F.least(F.col("_lo") + F.col("size"), F.col("_end"))
    )
    pieces = lines.filter("_lo < _hi").withColumn(
        "rank", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block)))
    )
    first = F.greatest(F.col("rank") * block, F.col("_lo"))
    last = F.least((F.col("rank") + 1) * block, F.col("_hi"))
    cutting = pieces.select(
        "_key", "rank", "id", "epoch", (first - F.col("_lo")).alias("first_word"), (last - first).alias("words")
    )
    slots = schedule(targets, block).select("slot", F.struct("source").alias("_key"), "rank")
    return cutting.join(slots, ["_key", "rank"]).select("slot", "id", "epoch", "first_word", "words")
