"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckspark.operators.skew import fits_broadcast, lookup_join
from deckspark.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until the frame has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def join_rows(docs: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """``docs`` inner-joined with a table by a key that names single rows.

    A measured small table is broadcast. Beyond that the rows move once, by a key that no two different
    rows share; their texts are not stored for it.
    """
    return docs.join(F.broadcast(side) if fits_broadcast(side) else side, on)


#: Bytes of text that travel to Python at once, where the session does not say otherwise.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by size, so that long texts do not fill a task's memory; a set bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def crc_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the cluster's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def running_total(df: DataFrame, within: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, within each group.

    Rows are ranged by (within, order) and checkpointed, so that a group that holds
    most rows spreads over partitions; sums of the partitions before are added.
    """
    keys = [*within, *order]
    ranged = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part", *within).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(
        F.struct("_part", *within).alias("_piece"), "_base"
    )
    inside = (
        Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).withColumn(
        "_piece", F.struct("_part", *within)
    )
    return lookup_join(rows, offsets, ["_piece"], "inner").select(
        *df.columns, (F.col("_inside") + F.col("_base")).alias(out)
    )
