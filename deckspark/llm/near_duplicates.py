"""Near-duplicate groups by DartMinHash (Christiani, 2020) and an exact check.

Every element of a document throws darts: hashed points in its region of (weight, rank). A dart has a
coordinate, and the earliest dart of each coordinate is that coordinate's value, so two documents
agree in a coordinate with a probability of their (weighted) Jaccard similarity. Only darts up to a rank
limit are thrown, about t ln t + 3t for t coordinates and any number of elements; documents with an
empty coordinate throw again up to twice the limit.

Elements are the 5-word shingles of the lower-cased text (words are parted by white space); a text of
fewer words is one shingle. Bands of coordinates give buckets. Documents with equal shingle sets
are one text from then on. Each text of a bucket is compared with the bucket's first. Texts of one bucket that
this leaves in different groups are then compared with each other, but for those whose own shingles rule
it out; so no link between candidates is lost, and the copies of a group are never expanded.
Comparisons are exact: similarity of whole shingle sets.

Defined cases: a null or wordless text has no shingles and is a copy of nothing but a repeated row; repeated rows are
copies; a document's group is named by its smallest doc_id; empty tables give no rows. The chance that a pair of similarity
0.8 shares no bucket is (1 - 0.8^5)^32, three in a million.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckspark.llm.common import bound_batches, cut, free_name, join_rows
from deckspark.llm.components import connected_components
from deckspark.llm.words import SPACED, Slice, mixed, slices, words
from deckspark.operators.skew import lookup_join
from deckspark.session import shared_dir

SHINGLE = 5
BANDS, ROWS = 32, 5
#: Hashed parts of a set whose sizes bound what two sets have in common.
PARTS = 32
_SEED = np.uint64(0x2545F4914F6CDD1D)
_DOC = np.uint64(0x9FB21C651E98DF25)


def shingles(part: Slice, length: int = SHINGLE, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, element) of a slice, by text. Elements are distinct within a text.

    With ``weighted`` a shingle that stands k times in a text is k elements, which is its weight
    in whole darts: the similarity is then that of the weighted sets.
    """
    own = words(part, SPACED)
    hashes, doc = own.hashes(), own.doc
    counts = np.bincount(doc, minlength=len(part))
    first = np.cumsum(counts) - counts
    # Shingle k starts at word k; short texts have one, of all their words.
    place = np.arange(len(doc)) - first[doc]
    starts = np.flatnonzero((place == 0) | (place + length <= counts[doc]))
    code = np.zeros(len(starts), np.uint64)
    for k in range(length):
        there = np.minimum(starts + k, len(doc) - 1) if len(doc) else starts
        value = mixed(hashes[there] + _SEED * np.uint64(k + 1))
        code += np.where(place[starts] + k < counts[doc[starts]], value, np.uint64(0))
    code, owner = mixed(code), doc[starts]
    key = mixed(code + owner.astype(np.uint64) * _DOC)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    if weighted:
        at = np.arange(len(key))
        nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
        code[order] = mixed(code[order] + nth.astype(np.uint64) * _SEED)
        return owner, code
    kept = np.sort(order[fresh])
    return owner[kept], code[kept]


def dart_signatures(owner: np.ndarray, code: np.ndarray, n_texts: int, t: int) -> np.ndarray:
    """The earliest rank of each of ``t`` coordinates, for each text. Texts without elements have infinities."""
    best = np.full(n_texts * t, np.inf)
    counts = np.bincount(owner, minlength=n_texts)
    wanted = counts > 0
    factor = 1.0
    while wanted.any():
        mine = wanted[owner]
        limit = factor * t * (np.log(t) + 3) / np.maximum(counts, 1)
        _throw(owner[mine], code[mine], limit, t, best)
        empty = np.isinf(best.reshape(n_texts, t)).any(1)
        wanted &= empty
        factor *= 2
    return best.reshape(n_texts, t)


def _throw(owner: np.ndarray, code: np.ndarray, limit: np.ndarray, t: int, best: np.ndarray) -> None:
    """An element's darts have the arrival times of a hashed Poisson process as ranks."""
    rank = np.zeros(len(code))
    step, width = 0, 1
    while len(code):
        number = np.arange(step + 1, step + width + 1, dtype=np.uint64)
        dart = mixed(code[:, None] + number[None, :] * _SEED)
        wait = -np.log1p(-(dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        # One after the other, so that the sums do not depend on how many are made at once.
        ranks = np.cumsum(np.concatenate([rank[:, None], wait], axis=1), axis=1)[:, 1:]
        thrown = ranks < limit[owner][:, None]
        coordinate = (mixed(dart + _DOC) >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)
        flat = owner[:, None] * t + coordinate.astype(np.int64)
        np.minimum.at(best, flat[thrown], ranks[thrown])
        rank = ranks[:, -1]
        on = thrown[:, -1]
        owner, code, rank = owner[on], code[on], rank[on]
        step += width
        width = 1 if step < 4 else int(min(256, max(1, 200_000 // max(1, len(code)))))


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    weights = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
    return mixed((mixed(bits) * weights).sum(2, dtype=np.uint64)).view(np.int64)


def _sums(values: np.ndarray, border: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[border[1:]] - total[border[:-1]]).view(np.int64)


SIGNED = pa.schema(
    [
        ("k1", pa.int64()),
        ("k2", pa.int64()),
        ("n", pa.int32()),
        ("bands", pa.list_(pa.int64())),
    ]
)


#: Bytes of text whose shingles are hashed together.
SLICE = 1 << 20


def sign(docs: DataFrame, text: str, keep: list[str], bands: int, rows: int, weighted: bool) -> DataFrame:
    """Names of the shingle sets (k1, k2) of all texts, their sizes and buckets."""
    frame = docs.select(*keep, F.col(text).alias("_text"))
    names = [*keep, *SIGNED.names]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(len(keep)), SLICE):
                owner, code = shingles(part, weighted=weighted)
                border = np.searchsorted(owner, np.arange(len(part) + 1))
                signed = band_hashes(dart_signatures(owner, code, len(part), bands * rows), bands, rows)
                has = np.diff(border) > 0
                band_border = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                columns = [
                    *_names(code, border),
                    pa.array(np.diff(border).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(band_border), pa.array(signed[has].ravel())),
                ]
                rest = [batch.column(k).slice(part.first, len(part)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, *columns], names)

    bound_batches(docs.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(make, f"{kept}, k1 bigint, k2 bigint, n int, bands array<bigint>")


def _names(code: np.ndarray, border: np.ndarray) -> list[pa.Array]:
    return [pa.array(_sums(mixed(code), border)), pa.array(_sums(mixed(code + _DOC), border))]


def shingle_sets(docs: DataFrame, text: str, weighted: bool) -> DataFrame:
    """(key, elements) of all texts with shingles; 32 bits stand for each element."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                owner, code = shingles(part, weighted=weighted)
                border = np.searchsorted(owner, np.arange(len(part) + 1))
                short = pa.array((code >> np.uint64(32)).astype(np.uint32).view(np.int32))
                sets = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), short)
                yield pa.RecordBatch.from_arrays([*_names(code, border), sets], ["k1", "k2", "elements"])

    bound_batches(docs.sparkSession)
    made = docs.select(text).mapInArrow(make, "k1 bigint, k2 bigint, elements array<int>")
    return made.filter(F.size("elements") > 0).select(F.struct("k1", "k2").alias("key"), "elements")


def _written(df: DataFrame) -> DataFrame:
    """A table in the shared folder: columns that a step does not need are not read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/signed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) whose sets have a similarity of at least share[0]/share[1]."""
    left = sets.select(F.col("key").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    both = F.size("left") + F.size("right") - common
    return (
        pairs.join(left, "a").join(right, "b").filter(common * share[1] >= both * share[0]).select("a", "b")
    )


def _alike(n: Column, m: Column, share: tuple[int, int]) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * share[1] >= F.greatest(n, m) * share[0]


def _still_possible(texts: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different groups in one bucket that can be similar enough; ``texts`` has (bucket, key, n, root).

    Elements of a text that no other of these texts has cannot be common to a pair. With the number of the others,
    and for each class of partner sizes, that bounds a text's similarity to anything of the class. Texts meet
    only in classes where both bounds allow it: those that differ from the middle of a large group in too
    many places never meet its other members.
    """
    own_sets = lookup_join(sets, cut(texts.select("key").distinct()), ["key"], "inner")
    rows = own_sets.select("key", F.explode("elements").alias("element")).distinct()
    common = rows.groupBy("element").agg(F.count("*").alias("owners")).filter("owners > 1").select("element")
    part = F.pmod("element", F.lit(PARTS))
    counts = (
        rows.join(common, "element", "left_semi")
        .groupBy("key")
        .agg(
            F.count("*").alias("common"),
            F.array(*[F.count(F.when(part == k, 1)).cast("int") for k in range(PARTS)]).alias("parts"),
        )
    )
    steps = 32.0  # size classes per factor e
    n, common_n = F.col("n").cast("double"), F.col("common").cast("double")
    limit = share[0] / share[1]
    low, high = F.exp(F.col("partner") / steps), F.exp((F.col("partner") + 1) / steps)
    best = F.greatest(low, F.least(high, common_n))
    meet = F.least(best, common_n)
    # Texts without a common element have no partner here.
    sized = _written(
        texts.join(counts, "key")
        .withColumn("own", F.floor(F.log(n) * steps))
        .withColumn(
            "partner",
            F.explode(F.sequence(F.floor(F.log(n * limit) * steps - 1e-6), F.floor(F.log(n / limit) * steps + 1e-6))),
        )
        .filter(meet >= limit * (n + best - meet) - 1e-6)
        .select("bucket", "key", "n", "root", "own", "partner", "parts")
    )
    other = sized.select(
        "bucket",
        F.col("key").alias("b"),
        F.col("n").alias("m"),
        F.col("root").alias("other"),
        F.col("own").alias("partner"),
        F.col("partner").alias("own"),
        F.col("parts").alias("parts_b"),
    )
    most = F.aggregate(F.zip_with("parts", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (
        sized.join(other, ["bucket", "own", "partner"])
        .filter((F.col("key") < F.col("b")) & (F.col("root") != F.col("other")))
        .filter(_alike(F.col("n"), F.col("m"), share))
        .filter(most * share[1] >= (F.col("n") + F.col("m") - most) * share[0])
        .select(F.col("key").alias("a"), "b")
        .distinct()
    )


def near_duplicate_groups(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    share: tuple[int, int] = (8, 10),
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
) -> DataFrame:
    """(doc_id, text_hash, class_id, root): one row per document, class_id the smallest doc_id of its group.

    ``text_hash`` is Spark's xxhash64 of the text; ``root`` names the group also where ids are null or repeat.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = _written(sign(narrow, "text", ["doc_id", "text_hash"], bands, rows, weighted))
    entries = signed.filter("n > 0").select("k1", "k2", "n", F.explode("bands").alias("bucket"))
    # Buckets with several texts; copies of one text are one.
    several = (
        entries.groupBy("bucket")
        .agg(*[f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)])
        .filter("min_k1 <> max_k1 or min_k2 <> max_k2")
        .select("bucket")
    )
    met_texts = _written(
        entries.join(several, "bucket").distinct().select("bucket", F.struct("k1", "k2").alias("key"), "n")
    )
    sets = _written(
        lookup_join(
            shingle_sets(narrow, "text", weighted), cut(met_texts.select("key").distinct()), ["key"], "inner"
        )
        .groupBy("key")
        .agg(F.any_value("elements").alias("elements"))
    )
    # Each text with the number of meetings it has over all its buckets. The text with most is the middle of
    # its group, if the group has one: it becomes the bucket's first.
    sizes = met_texts.groupBy("bucket").agg(F.count("*").alias("texts"))
    met = met_texts.join(sizes, "bucket").groupBy("key").agg(F.sum("texts").alias("met"))
    shared = met_texts.join(met, "key")
    heads = shared.groupBy("bucket").agg(F.max(F.struct("met", "key", "n")).alias("head"))
    first = met_texts.join(heads, "bucket").filter(F.col("key") != F.col("head.key")).filter(
        _alike(F.col("n"), F.col("head.n"), share)
    )
    links = cut(_verified(first.select(F.col("head.key").alias("a"), F.col("key").alias("b")).distinct(), sets, share))
    roots = connected_components(links)
    # Texts that share a bucket and are still in different groups.
    named = _written(
        met_texts.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
            "bucket", "key", "n", F.coalesce("root", "key").alias("root")
        )
    )
    parted = (
        named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    )
    second = _still_possible(_written(named.join(parted.select("bucket"), "bucket", "left_semi")), sets, share)
    more = cut(_verified(second, sets, share))
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))
    members = lookup_join(
        signed.select("doc_id", "text_hash", "n", F.struct("k1", "k2").alias("key")),
        roots.withColumnRenamed("node", "key"),
        ["key"],
    )
    alone = F.struct(F.col("doc_id").cast("long").alias("k1"), F.col("text_hash").alias("k2"))
    members = cut(
        members.select(
            "doc_id", "text_hash", F.when(F.col("n") > 0, F.coalesce("root", "key")).otherwise(alone).alias("root"), "n"
        ).withColumn("root", F.struct((F.col("n") > 0).alias("has"), "root.k1", "root.k2"))
    )
    names = members.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("_n"))
    several = names.filter("_n > 1").select("root", "class_id")
    return lookup_join(members, several, ["root"]).select(
        "doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), "root"
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, then text hash."""
    key = free_name(docs, "_key")
    groups = cut(near_duplicate_groups(docs, text, doc_id))
    first = Window.partitionBy("root").orderBy("doc_id", "text_hash")
    kept = groups.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    keys = kept.select(F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).alias(key)).distinct()
    marked = docs.withColumn(
        key, F.struct(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"))
    )
    out = join_rows(marked, keys, key)
    # Only rows that repeat both id and text are still several.
    if not groups.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([key])
    return out.select(*docs.columns)
