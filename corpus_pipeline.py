"""The corpus pipeline: language, near duplicates, contamination, mix and shards, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before, which was written as
Parquet and read again. All but the last return the columns of ``documents``.

Defined cases: see the operators. A text without letters, also a null one, has no language and goes with the
first stage. Of a near-duplicate group the document with the smallest id stays, of repeated rows one.
A document goes as contaminated by the rule of ``decontamination.contaminated``, else it stays unchanged.
The mix takes whole documents: a copy for each epoch of which it takes at least half the words, so
a document may come twice, or not at all. Shards follow from the id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckspark.llm import decontamination, languages, mixing, near_duplicates, sharding
from deckspark.llm.common import free_name, join_rows, table
from deckspark.session import shared_dir

SHARDS = 16
#: Least score of a language: below it the machines contradict each other.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language; a null ``lang`` gets the predicted one."""
    model = languages.train(docs)
    said, sure = free_name(docs, "_lang"), free_name(docs, "_score")
    judged = languages.predict(docs, model, lang=said, score=sure)
    kept = judged.filter((F.col(said) != languages.UNDETERMINED) & (F.col(sure) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", said)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free_name(docs, "_found")
    judged = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), out=found)
    return judged.filter(~decontamination.contaminated(found)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes at least half of its words; words of no document count for nothing."""

    def identity() -> Column:
        """Rows that agree in it are rows of one document; they are told apart by no column that the mix reads."""
        rest = [c for c in docs.columns if c not in ("doc_id", "source")]
        return F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.xxhash64(*rest).alias("h"))

    rows = mixing.measured(docs, identity().alias("_row"))
    targets = mixing.cut(mixing.source_targets(rows))
    taken = mixing.mix(rows, targets).groupBy("id", "epoch").agg(F.sum("words").alias("taken"))
    mark, number = free_name(docs, "_row"), free_name(docs, "_copies")
    copies = rows.join(taken, "id").filter(F.col("taken") * 2 >= F.col("size")).groupBy("_row").agg(F.count("*").alias("n"))
    # Repeated rows of one document share its copies; they are as many as the mix takes of them together.
    same = rows.groupBy("_row").agg(F.count("*").alias("same"))
    counts = copies.join(same, "_row").select(F.col("_row").alias(mark), F.struct("n", "same").alias(number))
    found = join_rows(docs.withColumn(mark, identity()), counts, mark)
    if not same.filter("same > 1").isEmpty():
        alone = found.filter(F.col(number)["same"] == 1)
        found = alone.unionByName(found.filter(F.col(number)["same"] > 1).dropDuplicates([mark]))
    repeated = F.explode(F.array_repeat(F.lit(1), F.col(number)["n"].cast("int")))
    return found.withColumn(number, repeated).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the shard."""
    return sharding.assign_shards(docs, "doc_id", SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The language machines and the hashes that order a mix are not expressible in SQL. tests/llm holds the stages for near
#: duplicates and contamination against brute force, the language stage against known languages, and the mix against its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``; stages are written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
