"""Table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_cards(cards: DataFrame) -> DataFrame:
    total = F.count("*")
    return cards.agg(total.alias("total"), (total == 0).alias("empty"))


def rows_per(table: DataFrame, column: str = "format") -> DataFrame:
    """Rows per value, most frequent first."""
    return table.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
