"""The bulk card export and the stored card table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deckspark.schemas import BULK_MANIFEST, CARD_EXPORT, CORRUPT, with_corrupt
from deckspark.session import shared_dir
from deckspark.sources.files import is_committed

# The variants of the export.
BULK_TYPES = ("oracle_cards", "unique_artwork", "default_cards", "all_cards")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """List of available exports: ``{"data": [{type, download_uri}, ...]}``."""
    envelope = spark.read.schema(f"data array<struct<{BULK_MANIFEST.replace(' string', ': string')}>>")
    return envelope.option("multiLine", True).json(path).select(F.inline("data"))


def export_path(manifest: DataFrame, bulk_type: str = "oracle_cards") -> str:
    found = manifest.filter(F.col("type") == bulk_type).select("download_uri").first()
    if found is None:
        types = manifest.agg(F.sort_array(F.collect_set("type"))).first()[0]
        raise ValueError(f"no export of type {bulk_type!r}; there are {types}")
    return found[0]


def read_export(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Card objects with their ``ordinal``: by file, place of the part in it, and row.

    Spark deals out parts of files by size, so row numbers alone would not follow the files.
    An export that is one JSON array is one task here; ``read_array`` divides it.
    ``lines`` reads exports split into lines instead, which Spark can divide.
    """
    names = StructType.fromDDL(CARD_EXPORT).fieldNames()
    # One misfit would mark a whole array as corrupt. Variants take any value, so
    # the types are checked card by card.
    loose = spark.read.schema(", ".join(f"{n} variant" for n in names)).option("multiLine", not lines)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    texts = loose.json(path).select(F.to_json(F.struct(*names)).alias("card"), place.alias("ordinal"))
    return parse_export(texts)


def _opened(text: Column) -> Column:
    """How many braces open outside strings, for a text without escapes."""
    return F.regexp_count(F.regexp_replace(text, r'"[^"]*("|$)', ""), F.lit(r"\{"))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """The same as ``read_export`` for a JSON array (or lines), read by as many tasks as it has parts.

    The scan cuts the file at closing braces, wherever they are, so that Spark divides it by bytes. What such a
    piece does to the depth depends on whether it starts inside a string. Escapes end within their piece, as a
    brace cannot be escaped. So each part is summed up for both cases; a pass over the parts' sums, a few
    per GB, says which case holds and how deep each part starts; then the pieces between two returns to depth
    zero are a card. A card's pieces may come from two parts. An export that is cut off, or has anything else between
    its cards, gives texts that do not parse and are set aside as such.
    """
    shared_dir(spark)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    scanned = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("row"),
        "value",
        plain.alias("plain"),
    )
    # Pieces are numbered by the scan, so it must run once.
    pieces = scanned.select(
        "file", "part", "row", "value",
        F.regexp_count("plain", F.lit('"')).alias("quotes"),
        _opened(F.col("plain")).alias("opened_outside"),
        _opened(F.concat(F.lit('"'), "plain")).alias("opened_inside"),
    ).checkpoint()

    inside_part = Window.partitionBy("file", "part").orderBy("row")
    earlier = inside_part.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("quotes").over(earlier), F.lit(0))

    def change(started_inside: int) -> Column:
        starts = (before + started_inside) % 2
        closes = F.when((before + started_inside + F.col("quotes")) % 2 == 0, 1).otherwise(0)
        return F.when(starts == 0, F.col("opened_outside")).otherwise(F.col("opened_inside")) - closes

    steps = pieces.withColumns({"step_outside": change(0), "step_inside": change(1)})
    by_part = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("file", "part").agg(
        F.sum("quotes").alias("quotes"), F.sum("step_outside").alias("outside"), F.sum("step_inside").alias("inside")
    )
    started = sums.withColumn("started_inside", F.coalesce(F.sum("quotes").over(by_part), F.lit(0)) % 2 == 1)
    moved = F.when(F.col("started_inside"), F.col("inside")).otherwise(F.col("outside"))
    parts = started.withColumn("moved", moved).select(
        "file", "part", "started_inside", F.coalesce(F.sum("moved").over(by_part), F.lit(0)).alias("depth")
    )
    step = F.when(F.col("started_inside"), F.col("step_inside")).otherwise(F.col("step_outside"))
    closed = (before + F.col("started_inside").cast("int") + F.col("quotes")) % 2 == 0
    deep = steps.join(parts, ["file", "part"]).withColumns({"step": step, "closed": closed})
    ends = deep.withColumn(
        "end", (F.col("closed") & (F.col("depth") + F.sum("step").over(inside_part) == 0)).cast("int")
    )
    ended = ends.groupBy("file", "part").agg(F.sum("end").alias("ended"))
    firsts = ended.select("file", "part", F.coalesce(F.sum("ended").over(by_part), F.lit(0)).alias("first"))
    numbered = ends.join(firsts, ["file", "part"]).select(
        "file", "part", "row", "value",
        (F.col("first") + F.coalesce(F.sum("end").over(earlier), F.lit(0))).alias("number"),
    )
    cards = numbered.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("part", "row", "value"))).alias("pieces")
    )
    joined = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), "}"), F.lit("}"))
    # What separates cards comes before one of them; after the last one comes the end of the array.
    text = F.regexp_replace(joined, r"^[\s,\[\x{FEFF}]+", "")
    texts = cards.select(
        text.alias("card"), F.struct("file", F.lit(0).cast("long").alias("part"), F.col("number").alias("row")).alias("ordinal")
    )
    return parse_export(texts.filter(~F.col("card").rlike(r"^(\][\s,]*)?\}$")))


def parse_export(texts: DataFrame, card: str = "card") -> DataFrame:
    """Card objects from a column of JSON texts; misfits keep their text aside."""
    schema = with_corrupt(CARD_EXPORT)
    parsed = F.from_json(card, schema, {"columnNameOfCorruptRecord": CORRUPT})
    return texts.select(parsed.alias("_card"), "ordinal").select("_card.*", "ordinal")


def land_export(spark: SparkSession, path: str, landed: str, lines: bool = False) -> DataFrame:
    """The export as parquet, written at the first call and reused later."""
    if not is_committed(spark, landed):
        (read_export(spark, path, lines) if lines else read_array(spark, path)).write.mode("overwrite").parquet(landed)
    return spark.read.parquet(landed)
