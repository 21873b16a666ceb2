"""Document fingerprints by one-permutation MinHash, on built-in expressions.

Every shingle of a text is hashed once. The top bits of a hash name its bin and a bin keeps its least hash.
Sorting the hashes together with one border per bin (its greatest hash) gives all bins in one pass: the first hash of
a bin is its minimum, and a bin whose first hash is the border is empty. Empty bins are filled by optimal
densification (Shrivastava, 2017): each bin has an order of preference over all bins that follows from the bin alone, and
takes over the first filled one. The order is a row of random probes, then all bins by a hash, so a filled bin is
always found. The low bits of the bins are the fingerprint. Two different minima share their low bits by
chance, which ``likeness`` corrects.

A shingle is five words of the lower-cased text; a text of fewer words is one shingle.

Defined cases: a null text counts as empty; a text without words has no shingles, its fingerprint is empty, and two such
are alike (1), but like no other (0). Ids may be null (the smallest) or repeat; documents of one id are put in
the order of their texts' hashes. An empty table gives no rows. A single document is its own next.
Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a shingle, and what stands between words.
SHINGLE = 5
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bins are 2^BIN_BITS. Two similarities of s are told apart within about sqrt(s (1 - s) / 2^BIN_BITS).
BIN_BITS = 8
#: Random probes before a bin goes through all bins by hash.
PROBES = 32
#: Chunks of neighbouring documents for each shuffle partition of the session.
CHUNKS = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, length: int = SHINGLE) -> Column:
    """64-bit hashes of the runs of ``length`` words of a text, made of the hashes of their words in order."""
    # Cutting at what is no word is several times faster than matching the words.
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")

    def runs(words: Column) -> Column:
        # A short text has one run; the places behind its end are null, which the hash passes over.
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - length, F.lit(0)))
        own = F.transform(starts, lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(length)]))
        return F.when(F.size(words) > 0, own).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(found, lambda w: F.xxhash64(w)), runs)


def bin_minima(hashes: Column, bin_bits: int = BIN_BITS) -> Column:
    """Least hash of each bin, in the order of the bins; null for empty bins."""
    low = 64 - bin_bits
    half = 1 << (bin_bits - 1)
    borders = F.expr(f"array({', '.join(f'{(b << low) | ((1 << low) - 1)}L' for b in range(-half, half))})")

    def firsts(hashes: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("long")), F.slice(hashes, 1, F.size(hashes) - 1))

        def if_first(own: Column, last: Column) -> Column:
            same = F.shiftright(own, low) == F.shiftright(last, low)
            return F.when(last.isNull() | ~same, own)

        minima = F.array_compact(F.zip_with(hashes, before, if_first))
        # A border is the one hash of its bin whose low bits are all set.
        empty = F.lit((1 << low) - 1).cast("long")
        return F.transform(minima, lambda m: F.when(m.bitwiseAND(empty) != empty, m))

    return let(F.sort_array(F.concat(hashes, borders)), firsts)


def _scatter(*parts: Column) -> Column:
    """A number that the parts decide, from 0 to 2^31 - 1."""
    return F.xxhash64(*parts).bitwiseAND(0x7FFFFFFF)


def densified(minima: Column, bin_bits: int = BIN_BITS) -> Column:
    """Bins with the empty ones filled from those they prefer; all stay null if all are."""
    bins = 1 << bin_bits

    def fill(minima: Column, filled: Column) -> Column:
        def probe(i: Column) -> list[Column]:
            # Probes of all bins by one attempt are a random function of the bin.
            return [F.get(minima, _scatter(i, F.lit(a)).bitwiseAND(bins - 1).cast("int")) for a in range(PROBES)]

        def by_hash(i: Column) -> Column:
            ranked = F.transform(filled, lambda b: F.struct(_scatter(i, b, F.lit(PROBES)).alias("place"), b.alias("bin")))
            return F.get(minima, F.array_min(ranked)["bin"])

        return F.transform(minima, lambda m, i: F.coalesce(m, *probe(i), by_hash(i)))

    def with_filled(minima: Column) -> Column:
        places = F.transform(minima, lambda m, i: F.when(m.isNotNull(), i))
        return let(F.array_compact(places), lambda filled: fill(minima, filled))

    return let(minima, with_filled)


def low_bits(text: Column, bin_bits: int = BIN_BITS, length: int = SHINGLE) -> Column:
    """The fingerprint of a text as one byte per bin; empty if it has no shingles."""

    def bins(hashes: Column) -> Column:
        full = densified(bin_minima(hashes, bin_bits), bin_bits)
        # The low byte, as a signed one.
        taken = F.transform(full, lambda m: (m.bitwiseAND(255) - 128).cast("tinyint"))
        return F.when(F.size(hashes) > 0, taken).otherwise(F.array().cast("array<tinyint>"))

    return let(shingle_hashes(text, length), bins)


def packed(bits: Column) -> Column:
    """A fingerprint as text: two hexadecimal digits for each bin."""
    return F.lower(F.array_join(F.transform(bits, lambda b: F.lpad(F.hex(b.cast("int") + 128), 2, "0")), ""))


def likeness(one: Column, other: Column) -> Column:
    """Estimated similarity of the shingle sets of two fingerprints: 0 to 1.

    A share s of equal sets and (1 - s) / 256 of the others agree in their low byte.
    """
    by_chance = 1.0 / 256
    equal = F.aggregate(F.zip_with(one, other, lambda a, b: a.eqNullSafe(b).cast("int")), F.lit(0), lambda s, e: s + e)
    share = equal / F.greatest(F.size(one), F.lit(1))
    estimate = F.greatest((share - by_chance) / (1 - by_chance), F.lit(0.0))
    return F.when((F.size(one) == 0) & (F.size(other) == 0), F.lit(1.0)).when(
        (F.size(one) == 0) | (F.size(other) == 0), F.lit(0.0)
    ).otherwise(estimate)


def neighbour_chunks(docs: DataFrame, key: str, text: str, chunks: int) -> list:
    """Greatest (id, hash) of each of about as many chunks as asked, ascending: as many pairs as chunks, not rows."""
    place = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"))
    ranged = place.repartitionByRange(chunks, "id", "hash").withColumn("part", F.spark_partition_id())
    tops = ranged.groupBy("part").agg(F.max(F.struct("id", "hash")).alias("top")).collect()
    return [r["top"] for r in sorted(tops, key=lambda r: r["part"])]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, text, next_text) and the carried columns with those of the next document (``next_<name>``).

    The next document is the one with the next smaller id, that of the last is the first. Documents are cut
    into chunks at borders of a range partitioning, and a chunk's greatest document is
    also sent to the chunk above it, so one exchange brings all neighbours together, and no window spans the table.
    """
    spark = docs.sparkSession
    chunks = CHUNKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tops = neighbour_chunks(docs, key, text, chunks)
    carry = carry or {}
    rows = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(text).alias("hash"),
        *[c.alias(name) for name, c in carry.items()],
    )
    kind = dict(rows.dtypes)["id"]
    if not tops:
        empty = rows.filter(F.lit(False))
        return empty.withColumns({f"next_{c}": F.col(c) for c in ("text", *carry)}).drop("hash")

    # Chunks are found in two steps, among groups of chunks and inside one, so the search stays short.
    width = max(1, int(len(tops) ** 0.5))
    groups = [tops[k : k + width] for k in range(0, len(tops), width)]

    def pair(top) -> Column:
        return F.struct(F.lit(top["id"]).cast(kind).alias("id"), F.lit(top["hash"]).cast("long").alias("hash"))

    own = F.struct("id", "hash")
    heads = F.array(*[pair(g[-1]) for g in groups[:-1]]) if len(groups) > 1 else None
    bodies = F.array(*[F.array(*[pair(t) for t in g]) for g in groups])

    def below(pairs: Column) -> Column:
        return F.size(F.filter(pairs, lambda t: t < own))

    group = below(heads) if heads is not None else F.lit(0)
    placed = rows.withColumn("_group", group)
    body = F.get(bodies, F.col("_group"))
    placed = placed.withColumn("_chunk", F.col("_group") * width + below(body)).withColumn(
        "_top", F.exists(body, lambda t: t == own)
    )
    copies = F.when(
        F.col("_top"),
        F.array(
            F.struct(F.col("_chunk").alias("chunk"), F.lit(True).alias("real")),
            F.struct(((F.col("_chunk") + 1) % len(tops)).alias("chunk"), F.lit(False).alias("real")),
        ),
    ).otherwise(F.array(F.struct(F.col("_chunk").alias("chunk"), F.lit(True).alias("real"))))
    sent = placed.select("id", "text", "hash", *carry, F.inline(copies))
    # Guests come first in their chunk: they are what its smallest document goes on with.
    order = Window.partitionBy("chunk").orderBy("real", "id", "hash")
    shown = sent.withColumns({f"next_{c}": F.lag(c).over(order) for c in ("text", *carry)})
    return shown.filter("real").select("id", "text", *carry, *[f"next_{c}" for c in ("text", *carry)])


def edited(text: Column, other: Column) -> Column:
    """A text whose last half of code points is replaced by the first as many (or all) of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_text, bits, edited_bits, next_bits) of every document, each text fingerprinted once."""
    rows = with_next(docs, key, text, {"bits": low_bits(F.col(text))})
    changed = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    return changed.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        "edited_text",
        "bits",
        low_bits(F.col("edited_text")).alias("edited_bits"),
        "next_bits",
    )
