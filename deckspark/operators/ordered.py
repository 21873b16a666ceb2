"""Ordered work split into bounded pieces.

A window over (key ORDER BY seq) puts all rows of a key in one task. The
operators that need order therefore cut the sequence into chunks, work inside
(key, chunk), and only then go over the chunk summaries of a key, which are
fewer by the chunk length. Chunk borders follow from the sequence value alone,
so a recomputed task cuts at the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckspark.operators.skew import lookup_join
from deckspark.session import shared_dir

#: Sequence numbers per chunk, as a power of two.
CHUNK_BITS = 20


def chunk_of(seq: Column, bits: int = CHUNK_BITS) -> Column:
    return F.shiftright(seq.cast("long"), bits)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key.

    The rank filter is also applied before the exchange (partial group limit),
    so a hot key sends one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def global_row_number(
    df: DataFrame, order: list[str], within: tuple[str, ...] = (), out: str = "row_number"
) -> DataFrame:
    """Dense 1-based row numbers over the whole frame, or within each of a few groups.

    The rows are range-partitioned by (within, order), so neither one big group
    nor the whole frame lands in one task. Positions inside the partitions are
    shifted by the sizes of the partitions before. ``order`` should be unique
    within a group. The ranged rows are checkpointed: both passes must see the
    same partitions, also after executors were lost.
    """
    shared_dir(df.sparkSession)
    keys = [*within, *order]
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
        .checkpoint()
    )
    # One row per partition and group. The partitions are contiguous, so these are
    # no more than the partitions and the groups together.
    pieces = ranged.groupBy("_part", *within).agg(
        F.count("*").alias("_n"), F.min("_mid").alias("_start")
    )
    before = (
        Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    side = offsets.select(
        F.struct("_part", *within).alias("_piece"), (F.col("_before") - F.col("_start") + 1).alias("_shift")
    )
    placed = ranged.withColumn("_piece", F.struct("_part", *within))
    return lookup_join(placed, side, ["_piece"], "inner").select(
        *df.columns, (F.col("_mid") + F.col("_shift")).alias(out)
    )
