"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckspark.llm import decontamination, fingerprints, languages, lines, maxent, mixing, near_duplicates, passages, pseudonyms, resampling, sharding, topk, toxicity, whitening
from deckspark.llm.common import crc_remainder, cut, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 15. A null text has size 1 and no checksum."""
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    sharded = sharding.assign_shards(narrow, "doc_id", 16, grown="grown_shard")
    return sharding.shard_slots(sharded, ["doc_id", "text_crc32", "size", "grown_shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all texts; labels of one remainder of five are never looked at."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels.select("doc_id", "toxic")))
    return scored.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without runs of lines that an earlier one, or an earlier part, has."""
    return lines.drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 50 words and more that an earlier one, or an earlier part, has."""
    return passages.drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document."""
    rows = mixing.measured(table(spark, sf_dir, "documents"))
    targets = cut(mixing.source_targets(rows))
    taken = mixing.mix(rows, targets).groupBy("id").agg(F.sum("words").alias("taken"))
    shares = targets.select(F.struct("source").alias("_key"), "source_size", "target")
    return (
        mixing.lookup_join(rows.withColumn("_key", F.struct("source")), shares, ["_key"], "inner")
        .join(taken, "id", "left")
        .select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with their valid numbers, dates and addresses permuted within their formats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts, learned from four remainders of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = docs.withColumn("training", crc_remainder(F.col("doc_id"), 5) != 1)
    scored = maxent.score_texts(marked, "training")
    return scored.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learned from the documents of three remainders of four."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_remainder(F.col("doc_id"), 4) == 2)
    model = languages.train(docs.filter(~F.col("held_out")))
    return languages.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in 13-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        decontamination.hit_words().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of each document, named by its smallest doc_id."""
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words and more, drawn by their likeness to the benchmark's words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they and the next document's are."""
    found = fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.packed(F.col("bits")).alias("fingerprint"),
        fingerprints.packed(F.col("edited_bits")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        fingerprints.likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole vectors on the first 16 components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_lines": op3_lines,
    "op3_passages": op3_passages,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_lm_scores": op7_lm_scores,
    "op8_languages": op8_languages,
    "op9_decontamination": op9_decontamination,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_resampling": op11_resampling,
    "op12_fingerprints": op12_fingerprints,
    "op13_whitening": op13_whitening,
}
