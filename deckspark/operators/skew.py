"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckspark.session import shared_dir

#: Largest side that may be broadcast, in bytes.
BROADCAST_BYTES = 32 << 20
#: Rows of one key from which on the key is cut into pieces of about this size.
HOT_ROWS = 5_000_000
#: Pieces for rows whose key is null; they match nothing, wherever they go.
NULL_PIECES = 4096


def measured_bytes(df: DataFrame) -> int:
    """Size of the values themselves: texts by their length, nested values by that of their JSON."""

    def width(name: str, kind: str) -> Column:
        if kind.startswith(("struct", "array", "map")):
            text = F.to_json(F.struct(name))
        elif kind == "string":
            text = F.col(name)
        else:
            return F.lit(8)
        return F.coalesce(F.octet_length(text), F.lit(0)) + 8

    widths = [width(name, kind) for name, kind in df.dtypes]
    return df.agg(F.coalesce(F.sum(reduce(Column.__add__, widths)), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the frame is small, by measure.

    Catalyst's estimate does not count: it ignores the fan-out of generators and the
    compression of files, so it is no upper bound.
    """
    return measured_bytes(df) <= limit


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many rows to a narrow table that is unique by ``on``.

    A table within the size limit is broadcast and the rows are not shuffled.
    With a larger one the join is shuffled, and each hot key is cut into pieces
    of about ``hot_rows`` rows: its table row is repeated once per piece. The
    pieces are dealt by a number of the stored row, so equal rows spread too, and
    a task that runs again deals them alike. The rows are evaluated once.
    """
    if fits_broadcast(table, broadcast_bytes):
        return rows.join(F.broadcast(table), on, how)

    shared_dir(rows.sparkSession)
    stored = rows.withColumn("_number", F.monotonically_increasing_id()).checkpoint()
    hot = (
        stored.groupBy(*on)
        .count()
        .filter(F.col("count") >= hot_rows)
        .select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("_pieces"))
    ).checkpoint()
    # One entry per hot_rows rows at most; beyond the limit it is joined like any table.
    side = F.broadcast(hot) if fits_broadcast(hot, broadcast_bytes) else hot
    no_key = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    salted = stored.join(side, on, "left").withColumn(
        "_salt",
        F.when(no_key, F.pmod("_number", F.lit(NULL_PIECES)))
        .otherwise(F.coalesce(F.pmod("_number", F.col("_pieces")), F.lit(0)))
        .cast("int"),
    )
    pieces = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    repeated = table.join(side, on, "left").withColumn("_salt", F.explode(pieces))
    joined = salted.drop("_pieces", "_number").join(repeated.drop("_pieces"), [*on, "_salt"], how)
    return joined.drop("_salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input that comes in fewer splits than there are.

    Larger inputs, whose scan already has enough tasks, are left as they are.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)
