"""Importance resampling towards a target distribution, by bit-sliced aggregation.

Word runs are hashed into buckets. A bucket's gain says how much likelier it is in the target than in the raw
corpus, as an integer. A document's weight is the mean gain of its features: its bucket counts are laid out as
bit planes (plane i holds bit i of all counts, one bit per bucket), the gains as planes of their bits and a plane of
their signs, and the sum of count times gain is a sum of powers of two times popcounts of ANDed planes. It is exact.
Gumbel noise that follows from the id turns the greatest weights into a sample without replacement.

Defined cases: a null or empty text has no features and weight 0; ids may be null (the noise is then that of
the empty id) or repeat, and rows that repeat are drawn as documents of their own; ties go to the smaller id.
An empty table gives no rows, an empty target gives every bucket that the corpus holds a loss. Texts are
worked on in slices, so one very long text is the most that a task holds. Other columns are never looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckspark.llm.common import bound_batches, cut
from deckspark.llm.words import ALPHANUMERIC, Words, slices, words
from deckspark.operators.ordered import global_row_number

BUCKETS = 10_000
#: Texts whose planes are laid out together.
PLANE_ROWS = 256
#: Words of at most this many bytes are hashed together, longer ones one by one.
SHORT_WORD = 32


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320, as in every crc32."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()


def word_crc32(found: Words) -> np.ndarray:
    """crc32 of each word: one step per byte position over all words that are long enough."""
    length = found.end - found.start
    order = np.argsort(-np.minimum(length, SHORT_WORD + 1), kind="stable")
    start, size = found.start[order], length[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(SHORT_WORD, int(size.max(initial=0)))):
        live = int(np.searchsorted(-np.minimum(size, SHORT_WORD + 1), -k, "left"))
        byte = found.data[start[:live] + k]
        state[:live] = (state[:live] >> np.uint32(8)) ^ _CRC[(state[:live] ^ byte) & np.uint32(0xFF)]
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for at in np.flatnonzero(length > SHORT_WORD):
        out[at] = zlib.crc32(found.data[found.start[at] : found.end[at]].tobytes())
    return out


def _features(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature within these, its bucket) of slices of a text column."""
    for part in slices(texts):
        found = words(part, ALPHANUMERIC)
        yield part.first, len(part), found.doc, (word_crc32(found) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; each task sends at most one row per bucket."""
    bound_batches(texts.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket in _features(batch.column("text"), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    counted = texts.select("text").mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) per bucket; as many numbers as buckets come to the driver."""
    both = (
        bucket_counts(docs, buckets).withColumnRenamed("n", "s")
        .join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "full_outer")
    )
    raw, wanted = [0] * buckets, [0] * buckets
    for row in both.collect():
        raw[row["bucket"]], wanted[row["bucket"]] = row["s"] or 0, row["t"] or 0
    s_all, t_all = float(sum(raw)), float(sum(wanted))
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
            for s, t in zip(raw, wanted)
        ],
        np.int64,
    )


def planes(rows: np.ndarray, bucket: np.ndarray, value: np.ndarray, n_rows: int, buckets: int) -> list[np.ndarray]:
    """Bit planes of the values: plane i is (n_rows, words of 64 buckets) with bit i of each row's value at the bucket.

    (row, bucket) pairs are distinct and sorted.
    """
    width = -(-buckets // 64)
    word = rows * width + (bucket >> 6)
    bit = np.uint64(1) << (bucket & 63).astype(np.uint64)
    out = []
    for i in range(int(value.max(initial=0)).bit_length()):
        set_here = (value >> i) & 1 == 1
        plane = np.zeros(n_rows * width, np.uint64)
        at, bits = word[set_here], bit[set_here]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        plane[at[first]] = np.bitwise_or.reduceat(bits, first)
        out.append(plane.reshape(n_rows, width))
    return out


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Planes of the gains with their worth: 2^i for bit i of positive gains, -2^i for that of negative ones."""
    signed = []
    for sign in (1, -1):
        size = np.maximum(sign * gains, 0)
        some = np.flatnonzero(size)
        own = planes(np.zeros(len(some), np.int64), some, size[some], 1, len(gains))
        signed += [(sign << i, plane[0]) for i, plane in enumerate(own)]
    return signed


def gain_sums(rows: np.ndarray, bucket: np.ndarray, n_rows: int, signed: list[tuple[int, np.ndarray]], buckets: int) -> np.ndarray:
    """Sum of the gains of each row's features, by popcounts."""
    key, count = np.unique(rows * buckets + bucket, return_counts=True)
    total = np.zeros(n_rows, np.int64)
    for i, plane in enumerate(planes(key // buckets, key % buckets, count, n_rows, buckets)):
        used = np.flatnonzero(plane.any(axis=1))
        for worth, gain in signed:
            total[used] += (worth << i) * np.bitwise_count(plane[used] & gain).sum(axis=1, dtype=np.int64)
    return total


def weigh(docs: DataFrame, gains: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_features, weight) of all texts: the floored mean of the gains of a text's features."""
    bound_batches(docs.sparkSession)
    buckets, signed = len(gains), gain_planes(gains)

    def work(batches):
        for batch in batches:
            n_features = np.zeros(len(batch), np.int64)
            total = np.zeros(len(batch), np.int64)
            for first, n_rows, row, bucket in _features(batch.column("text"), buckets):
                n_features[first : first + n_rows] = np.bincount(row, minlength=n_rows)
                for start in range(0, n_rows, PLANE_ROWS):
                    stop = min(start + PLANE_ROWS, n_rows)
                    a, b = np.searchsorted(row, (start, stop))
                    total[first + start : first + stop] = gain_sums(
                        row[a:b] - start, bucket[a:b], stop - start, signed, buckets
                    )
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_features": pa.array(n_features), "weight": pa.array(weight)}
            )

    kind = dict(docs.dtypes)[key]
    narrow = docs.select(F.col(key).alias("doc_id"), "text")
    return narrow.mapInArrow(work, f"doc_id {kind}, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths that follows from seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    buckets: int = BUCKETS,
    key: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null if it is not drawn.

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn. The narrow scored rows are
    stored, as ranking them goes over them more than once; ranks come from a range partitioning.
    """
    gains = bucket_gains(docs, target, buckets)
    scored = cut(weigh(docs, gains, key).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = scored.filter(F.col("n_features") >= least_words)
    wanted = fit.count() * percent // 100
    ranked = global_row_number(fit.withColumn("_down", -F.col("score")), ["_down", "doc_id"], out="rank")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    others = scored.filter(F.col("n_features") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*columns).unionByName(others.select(*columns))
