"""Language identification in two steps: the family first, then the languages within it.

Features are hashed byte n-grams (1 to 3) of letters of the whole text, lower-cased in ASCII, with anything
that is no letter as one space; a text is a vector of square roots of shares, of length one. Families
are found from the labels: languages are joined by average linkage of their mean vectors. One linear
machine per pair of families, and within a family one per pair of languages, vote;
ties go to the greater sum of margins.

The models are fitted on at most ``rows_per_language`` labelled rows of each language. All else covers all texts.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; with one learned language
every text with a letter gets it with score 1; with none, ``und``; repeated rows are judged alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckspark.llm.common import bound_batches, free_name
from deckspark.llm.linear import PackedRows, fit_svm
from deckspark.llm.words import Slice, slices

#: Hashed features. Unigrams and bigrams of the commonest bytes share the space with trigrams.
FEATURES = 1 << 12
#: About as many labelled texts of a language the models are fitted on, those with the smallest hashes.
ROWS_PER_LANGUAGE = 1500
UNDETERMINED = "und"
_SIGNS = np.uint32(0x9E3779B1)
_LETTER = np.full(256, 32, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def features(part: Slice) -> np.ndarray:
    """One vector per text of a slice."""
    n = len(part)
    # A space before and behind each text, so that no n-gram spans two.
    lengths = np.diff(part.ends)
    row = np.repeat(np.arange(n), lengths + 2)
    code = np.full(len(row), 32, np.uint32)
    place = np.arange(len(part.data)) + 2 * np.repeat(np.arange(n), lengths) + 1
    code[place] = _LETTER[part.data]
    # Runs of spaces are one.
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    vector = np.zeros((n, FEATURES), np.float32)
    gram = np.zeros(len(code), np.uint32)
    for size in (1, 2, 3):
        ahead = code[size - 1 :]
        gram = gram[: len(ahead)] * np.uint32(257) + ahead
        inside = row[size - 1 :] == row[: len(ahead)]
        slot = ((gram + np.uint32(size)) * _SIGNS) >> np.uint32(32 - 12)
        flat = row[: len(ahead)][inside] * FEATURES + slot[inside].astype(np.int64)
        count = np.bincount(flat, minlength=n * FEATURES).reshape(n, FEATURES)
        vector += count / np.maximum(1, count.sum(1, keepdims=True))
    vector = np.sqrt(vector)
    return vector / np.maximum(1e-9, np.sqrt((vector * vector).sum(1, keepdims=True)))


@dataclass
class Vote:
    """One machine for each pair of classes: rows of ``weights`` decide for the first of ``pairs`` if positive."""

    names: list
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fit(x: PackedRows, y: list, names: list) -> Vote:
        pairs = list(itertools.combinations(range(len(names)), 2))
        label = np.array([names.index(v) for v in y])
        made = []
        for a, b in pairs:
            mine = (label == a) | (label == b)
            made.append(fit_svm(x.part(mine), np.where(label[mine] == a, 1.0, -1.0)))
        weights = np.array([w for w, _ in made], np.float32).reshape(len(pairs), x.shape[1])
        return Vote(names, pairs, weights, np.array([b for _, b in made], np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, confidence from 0 to 1) of each row."""
        wins = np.zeros((len(x), len(self.names)))
        sums = np.zeros((len(x), len(self.names)))
        margins = x @ self.weights.T + self.bias
        for (a, b), m in zip(self.pairs, margins.T, strict=True):
            wins[:, a] += m > 0
            wins[:, b] += m <= 0
            sums[:, a] += m
            sums[:, b] -= m
        # Among the classes with most wins the greatest sum of margins decides.
        best = np.argmax(np.where(wins == wins.max(1, keepdims=True), sums, -np.inf), axis=1)
        sure = np.ones(len(x))
        for (a, b), m in zip(self.pairs, margins.T, strict=True):
            for own, signed in ((a, m), (b, -m)):
                mine = best == own
                sure[mine] = np.minimum(sure[mine], 1 / (1 + np.exp(-3 * np.clip(signed[mine], -10, 10))))
        return best, sure


@dataclass
class LanguageModel:
    families: list[list[str]]
    between: Vote
    within: list[Vote]

    @staticmethod
    def fit(x: PackedRows, y: list[str]) -> LanguageModel:
        languages = sorted(set(y))
        family = group_languages({name: x[np.array([v == name for v in y])].mean(0) for name in languages})
        of = {name: k for k, names in enumerate(family) for name in names}
        between = Vote.fit(x, [of[v] for v in y], list(range(len(family))))
        within = []
        for names in family:
            mine = [v in names for v in y]
            within.append(Vote.fit(x.part(mine), [v for v in y if v in names], names))
        return LanguageModel(family, between, within)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.between.predict(x)
        names = np.empty(len(x), object)
        for k, vote in enumerate(self.within):
            mine = np.flatnonzero(family == k)
            if len(mine):
                best, own = vote.predict(x[mine])
                names[mine] = [vote.names[i] for i in best]
                sure[mine] *= own
        return names.tolist(), sure


def group_languages(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Families: average linkage of the mean vectors down to about the root of the number of languages."""
    groups = [[name] for name in sorted(means)]
    wanted = max(1, round(len(groups) ** 0.5))

    def likeness(a: list[str], b: list[str]) -> float:
        return float(np.mean([means[i] @ means[j] for i in a for j in b]))

    while len(groups) > wanted:
        i, j = max(itertools.combinations(range(len(groups)), 2), key=lambda p: likeness(groups[p[0]], groups[p[1]]))
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
    return groups


def labelled_sample(docs: DataFrame, text: str, lang: str, rows_per_language: int) -> DataFrame:
    """(lang, text): of each language about ``rows_per_language`` distinct texts, those with the smallest hashes.

    Hashes are even, so the wanted share of a language's distinct texts is the one below that share of all
    hashes: narrow rows are counted and nothing is ranked. As many thresholds as languages go to the driver. A
    language with no more texts than wanted is taken whole; else their number strays by about its square root.
    """
    rows = docs.filter(has_letter(F.col(text)) & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("by")
    )
    counts = rows.select("lang", "by").distinct().groupBy("lang").count().collect()
    most = {r["lang"]: min(2**63 - 1, -(2**63) + 2**64 * rows_per_language // r["count"]) for r in counts}
    if not most:
        return rows.select("lang", "text").limit(0)
    limits = F.create_map(*[x for name, top in most.items() for x in (F.lit(name), F.lit(top).cast("long"))])
    few = rows.filter(F.col("by") <= F.element_at(limits, F.col("lang")))
    # Copies are combined before they are moved.
    return few.groupBy("lang", "by").agg(F.min("text").alias("text")).select("lang", "text")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE):
    """A model of the languages that label ``docs``; null labels do not count. None if there are none."""
    spark = docs.sparkSession

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), 1 << 19):
                for few in _few(part, 256):
                    rows = [np.round(v * 255 / max(1e-9, v.max())).astype(np.uint8).tobytes() for v in features(few)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(few.first, len(few)), pa.array(rows, pa.binary())], ["lang", "vector"]
                    )

    bound_batches(spark)
    sample = labelled_sample(docs, text, lang, rows_per_language).select("lang", "text")
    rows = sample.mapInArrow(vectors, "lang string, vector binary").collect()
    if not rows:
        return None
    rows.sort()
    names, packed = [r[0] for r in rows], np.stack([np.frombuffer(r[1], np.uint8) for r in rows])
    del rows
    return LanguageModel.fit(PackedRows(packed), names)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", lang: str = "lang_pred", score: str = "score"):
    """``docs`` with the predicted language and its score; columns of these names are replaced."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    bound_batches(spark)
    letter = free_name(docs, "_letter")
    frame = docs.drop(lang, score).withColumn(letter, has_letter(F.col(text)))
    names = [*frame.columns[:-1], lang, score]
    at = frame.columns.index(text)
    schema = frame.drop(letter).withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0)).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            said, sure = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            letters = batch.column(batch.num_columns - 1).to_pylist()
            if own is not None:
                for part in slices(batch.column(at), 1 << 19):
                    # A dense vector per text: short texts are taken some hundreds at a time.
                    for few in _few(part, 256):
                        best, own_sure = own.predict(features(few))
                        for k, (name, value) in enumerate(zip(best, own_sure.tolist(), strict=True), few.first):
                            if letters[k]:
                                said[k], sure[k] = name, value
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(said, pa.string()), pa.array(sure, pa.float64())], names
            )

    return frame.mapInArrow(judge, schema)


def _few(part: Slice, rows: int) -> Iterator[Slice]:
    for k in range(0, len(part), rows):
        ends = part.ends[k : k + rows + 1]
        yield Slice(part.first + k, part.data[ends[0] : ends[-1]], ends - ends[0])
