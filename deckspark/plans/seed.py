"""Seed or refresh the card dimension from a landed export."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from deckspark.operators.cards import (
    count_changes,
    count_collisions,
    extend_status,
    first_of_name,
    parse_cards,
    split_corrupt,
    upsert_cards,
)
from deckspark.operators.stats import rows_per, total_cards
from deckspark.sources.cards import export_path, land_export, read_manifest
from deckspark.sources.snapshots import SnapshotTable


class Seeded(NamedTuple):
    updated: int
    inserted: int
    collisions: int


def seed_cards(
    raw: DataFrame,
    cards: SnapshotTable,
    status: SnapshotTable,
    version: int,
    refresh_all: bool = False,
) -> Seeded:
    """Merge raw card objects into version ``version`` of the card and status tables.

    Formats of known cards are left alone, unless ``refresh_all`` asks for the
    rows of newly legal formats too.
    """
    good, bad = split_corrupt(raw)
    bad.write.mode("overwrite").parquet(f"{cards.path}_rejected/v={version}")
    parsed = parse_cards(good)
    stored = cards.read(below=version)
    merged = upsert_cards(stored, first_of_name(parsed))
    # The change flags are wanted three times; the written table carries them.
    marked = SnapshotTable(cards.spark, f"{cards.path}_changes", f"{cards.schema}, change string")
    merged = marked.write(merged, version)
    written = cards.write(merged.drop("change"), version)
    fresh = written if refresh_all else merged.filter("change = 'inserted'").drop("change")
    status.write(extend_status(status.read(below=version), fresh), version)
    changes = count_changes(merged).first()
    return Seeded(changes["updated"], changes["inserted"], count_collisions(parsed).first()[0])


def seed_from_manifest(
    spark: SparkSession,
    manifest: str,
    landed: str,
    cards: SnapshotTable,
    status: SnapshotTable,
    version: int,
    bulk_type: str = "oracle_cards",
    refresh_all: bool = False,
    lines: bool = False,
) -> Seeded:
    path = export_path(read_manifest(spark, manifest), bulk_type)
    raw = land_export(spark, path, f"{landed}/{bulk_type}", lines)
    return seed_cards(raw, cards, status, version, refresh_all)


def table_stats(cards: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Total of cards, and tracked units per format."""
    return total_cards(cards), rows_per(status)
