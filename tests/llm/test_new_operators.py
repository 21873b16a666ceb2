"""Resampling, fingerprints and whitening against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from deckspark.llm import fingerprints, queries, resampling, whitening
from deckspark.llm.words import ALPHANUMERIC, slices, words

DOCS = "doc_id long, text string, id int, _chunk string, weight string, rank int, bits int, score int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def some_texts():
    """Nulls, empty and long texts, repeated rows, ties, long words."""
    body = " ".join(f"word{k % 37} Straße" for k in range(60))
    return [
        (1, body), (2, body), (3, None), (4, ""), (5, "!! ?"), (None, "lone text of a null id"), (7, body + " end"),
        (7, body + " end"), (7, "another text of one id"), (8, "long words " * 20_000), (9, "x" * 5000 + " y"),
        (10, "漢字" * 400), (11, " ".join(f"w{k}" for k in range(500))), (-3, "Four words are here"), (12, "A\tb\nC"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4) for r in rows], DOCS)


def plain_words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(lowered)


# --- resampling ---------------------------------------------------------------------------------


def test_word_checksums():
    texts = pa.array([t for _, t in some_texts()])
    (part,) = slices(texts)
    got = resampling.word_crc32(words(part, ALPHANUMERIC)).tolist()
    assert got == [zlib.crc32(w.encode()) for t in texts.to_pylist() for w in plain_words(t)]


def test_sums_by_planes_are_those_by_products():
    rng = np.random.default_rng(5)
    gains = rng.integers(-9000, 9000, 10_000)
    gains[:3] = (0, -1, 1 << 14)
    rows = np.sort(rng.integers(0, 50, 40_000))
    bucket = (rng.random(40_000) ** 4 * 10_000).astype(np.int64)
    got = resampling.gain_sums(rows, bucket, 50, resampling.gain_planes(gains), 10_000)
    assert got.tolist() == np.bincount(rows, gains[bucket], minlength=50).astype(np.int64).tolist()
    assert resampling.gain_sums(rows[:0], bucket[:0], 3, resampling.gain_planes(gains), 10_000).tolist() == [0] * 3


def brute_resample(docs, target, percent):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for w in plain_words(text):
                counts[zlib.crc32(w.encode()) % 10_000] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 1e4) / ((a + 1.0) * (sum(t) + 1e4)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in docs:
        own = plain_words(text)
        weight = sum(gain[zlib.crc32(w.encode()) % 10_000] for w in own) // max(1, len(own))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = len(fit) * percent // 100
    ranks = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(fit)]
    return ranks + [(*r, None) for r in out if r[1] < 20]


@pytest.mark.parametrize("percent", [10, 50, 100])
def test_resample_equals_brute_force(spark, percent):
    docs = some_texts() * 2
    target = ["word1 word2 straße", None, "", "漢字 w3 w4"]
    items = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, n int")
    got = resampling.resample(frame(spark, docs), items, percent).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_resample(docs, target, percent)))


def test_resample_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(frame(spark, []), items).count() == 0
    got = resampling.resample(frame(spark, some_texts()), items).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_resample(some_texts(), [], 10)))


# --- fingerprints -------------------------------------------------------------------------------


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def spark_hash(values):
    """xxhash64 as Spark chains it: strings by their bytes, longs and ints by their little-endian ones."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def long_bytes(v):
    return (v % 2**64).to_bytes(8, "little")


def int_bytes(v):
    return (v % 2**32).to_bytes(4, "little")


def scatter(*parts):
    return spark_hash([int_bytes(p) for p in parts]) & 0x7FFFFFFF


def brute_fingerprint(text):
    found = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower()) if w]
    if not found:
        return ""
    own = [spark_hash([w]) for w in found]
    runs = [own[k : k + 5] for k in range(max(1, len(own) - 4))]
    bins = [None] * 256
    for h in (signed(spark_hash([long_bytes(v) for v in run])) for run in runs):
        b = (h >> 56) + 128
        bins[b] = h if bins[b] is None else min(h, bins[b])
    filled = [b for b in range(256) if bins[b] is not None]
    out = []
    for i in range(256):
        h = bins[i]
        for a in range(32):
            if h is None:
                h = bins[scatter(i, a) & 255]
        if h is None:
            h = bins[min(filled, key=lambda b: (scatter(i, b, 32), b))]
        out.append(h & 255)
    return bytes(out).hex()


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    equal = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b))) / 256
    return max(0.0, (equal - 1 / 256) / (1 - 1 / 256))


def test_fingerprint_equals_brute_force(spark):
    texts = [t for _, t in some_texts()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = dict(df.select("k", fingerprints.packed(fingerprints.low_bits(F.col("t")))).collect())
    assert got == {k: brute_fingerprint(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_neighbours_and_edits_equal_brute_force(spark, tmp_path, partitions):
    """Each document with the one below; ids may repeat and be null."""
    rows = some_texts() + [(100 + k, f"text number {k} " * (k % 7 + 1)) for k in range(80)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = queries.op12_fingerprints(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hash_of = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    up = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of[r[1]]))
    wanted = []
    for (doc_id, text), (_, other) in zip(up, up[-1:] + up[:-1]):
        text, other = text or "", other or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + other[:half]
        marks = brute_fingerprint(text), brute_fingerprint(edit), brute_fingerprint(other)
        wanted.append(
            (doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), marks[0], marks[1],
             round(brute_likeness(marks[0], marks[1]), 12), round(brute_likeness(marks[0], marks[2]), 12))
        )
    short = [(*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, got)]
    assert sorted(short, key=str) == sorted(wanted, key=str)


def test_fingerprints_of_few_documents(spark):
    assert fingerprints.fingerprint_neighbours(frame(spark, [])).count() == 0
    (row,) = fingerprints.fingerprint_neighbours(frame(spark, [(5, "abcdef")])).collect()
    assert (row["id"], row["n_chars"], row["edited_text"]) == (5, 6, "abcabc")


# --- whitening ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, id int, x string, component int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, "a", 2, 3) for k, v in rows], VECTORS)


def some_vectors(d=20, n=300):
    rng = np.random.default_rng(3)
    rows = [(k, v) for k, v in enumerate((rng.normal(size=(n, d)) * np.arange(1, d + 1)).tolist())]
    rows += [(900 + k, rows[0][1]) for k in range(200)]
    return rows + [(None, rows[1][1]), (5, rows[2][1])]


def test_whitening_equals_brute_force(spark):
    rows = some_vectors()
    left_out = [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (2004, [])]
    got = whitening.whiten(vectors(spark, rows + left_out)).collect()
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n = len(u)
    centred = u - u.sum(0) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    white = np.abs(((x - u.sum(0) / n) @ v / np.sqrt(e))[:, :16])
    deviation = ((n * x - u.sum(0)) ** 2).sum(1)
    wanted = sorted(
        (str(k), c + 1, n, int(deviation[i]), round(float(white[i, c]), 6), round(float(e[c] / e.sum()), 8))
        for i, (k, _) in enumerate(rows) for c in range(16)
    )
    assert sorted((str(r["id"]), r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 8)) for r in got) == wanted
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_covariance_is_exact(spark):
    """Entries so far apart that products do not fit in 64 bits."""
    rows = [(k, [float(2**50 * k), float(k * k), 1.0]) for k in range(50)]
    fitted = whitening.fit_list(whitening.quantised(vectors(spark, rows)))
    n, sums, matrix = whitening.covariance(fitted)
    x = [[int(c * 64) + 1_000_000 for c in v] for _, v in rows]
    assert (n, sums) == (50, [sum(c) for c in zip(*x)])
    for a in range(3):
        for b in range(3):
            total = sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x)
            assert matrix[a][b] * n**3 == total


def test_whitening_of_flat_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    flat = whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(4)])).collect()
    assert {(r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in flat} == {
        (1, 1, 0, None, None), (2, 1, 0, None, None)
    }
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 7.0]) for k in range(4)])).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: (r["id"], r["component"]))] == [False, True, True] * 4
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
