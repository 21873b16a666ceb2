"""Removal of repeated runs of lines, by winnowing over line hashes.

Lines with other than white space count; they are compared without white space at their ends. A run of lines
is removed where it was seen before, in the order of (doc_id, position), if it has at least three lines or
at least ``min_words`` words. Such a run consists of small windows: three lines, or one or two with enough
words. A window's fingerprint is the least line hash in it, so equal windows have equal fingerprints
and a fingerprint stands for all windows that chose it. Fingerprints that occur once are dropped. The others'
positions are joined by fingerprint and window, the first stays, and matched windows that overlap or
touch are one match, which so extends both ways as far as the texts agree.

All windows are stored, not only the minima that they select, so that windows are compared with each first
occurrence and no match has to be extended; a fingerprint follows from its window and selects nothing.
This costs disk (README).

A line goes if and only if it lies in such a run that occurred earlier, byte for byte, up to collisions of 64-bit
hashes (the texts behind equal hashes are not compared). Only whole lines are
compared, as in the SQL of `op3_lines`: a passage that starts and ends inside longer lines stays. Those are
found by ``passages``.

Defined cases: null stays null; blank lines go with a run only if it has them inside; rows that repeat
both id and text are one document and get the same result; null ids come first; texts of any
length are handled whole, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckspark.llm.common import cut, free_name
from deckspark.llm.words import byte_class, mixed, slices, words

RUN_LINES, RUN_WORDS = 3, 50
_SPACE = " \t\n\r\x0b\x0c"
#: A word of a line, and a whole line as one word of all its bytes.
WORD = re.compile("[^\x20\x09-\x0d]+")
WHOLE = byte_class(lower=False)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def counted_lines(text: str) -> list[str]:
    return [line.strip(_SPACE) for line in text.split("\n") if line.strip(_SPACE)]


def windows(lines: list[str], run_lines: int, run_words: int) -> tuple[np.ndarray, ...]:
    """(fingerprint, window hash, first line, number of lines) of all windows of a text."""
    n = len(lines)
    hashes, counts = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    if n:
        for part in slices(pa.array(lines, pa.string())):
            own = words(part, WHOLE)
            hashes[part.first + own.doc] = own.hashes()
        counts = np.array([len(WORD.findall(line)) for line in lines])
    found = []
    for size in range(1, run_lines + 1):
        if n < size:
            break
        starts = np.arange(n - size + 1)
        stacked = np.stack([hashes[k : n - size + 1 + k] for k in range(size)])
        long = sum(counts[k : n - size + 1 + k] for k in range(size)) >= run_words
        code = np.full(n - size + 1, np.uint64(size))
        for row in stacked:
            code = mixed(code * _SEED + row)
        taken = np.full(len(starts), True) if size == run_lines else long
        found.append((stacked.min(0)[taken], code[taken], starts[taken], np.full(taken.sum(), size)))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    prints, codes, starts, sizes = (np.concatenate(c) for c in zip(*found, strict=True))
    return prints.view(np.int64), codes.view(np.int64), starts, sizes


def without_lines(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the counted lines of the given (first, number) runs, and blank lines within."""
    flags = np.zeros(len(text.split("\n")) + 1, np.int64)
    for first, number in gone:
        flags[first] += 1
        flags[first + number] -= 1
    drop = np.cumsum(flags) > 0
    kept, at, blanks, inside = [], 0, [], False
    for line in text.split("\n"):
        if not line.strip(_SPACE):
            blanks.append(line)
            continue
        if drop[at]:
            if not inside:
                kept += blanks
            inside = True
        else:
            kept += blanks
            kept.append(line)
            inside = False
        blanks = []
        at += 1
    return "\n".join(kept + blanks)


def drop_repeated_runs(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    run_lines: int = RUN_LINES,
    run_words: int = RUN_WORDS,
    removed: str = "n_removed",
) -> DataFrame:
    """``docs`` with repeated runs removed from its texts, and the number of lines that went."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "print", "window", "first", "lines"]
        for batch in batches:
            for row, whole in enumerate(batch.column(1)):
                found = windows(counted_lines(whole.as_py() or ""), run_lines, run_words)
                if len(found[0]):
                    doc = batch.column(0).take(pa.array(np.full(len(found[0]), row)))
                    yield pa.RecordBatch.from_arrays([doc, *[pa.array(c.astype(np.int64)) for c in found]], names)

    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    document, gone_runs = free_name(docs, "_doc"), free_name(docs, "_gone")
    keyed = docs.withColumn(document, key)
    kind = keyed.schema[document].dataType.simpleString()
    places = cut(
        keyed.select(F.col(document).alias("_doc"), F.col(text).alias("_text")).mapInArrow(
            _batched(fingerprints), f"doc {kind}, print bigint, window bigint, first bigint, lines bigint"
        )
    )
    # The first place of each window; a third of all rows may share one, so it is a partial minimum.
    firsts = (
        places.groupBy("print", "window")
        .agg(F.min(F.struct("doc", "first")).alias("origin"), F.max(F.struct("doc", "first")).alias("last"))
        .filter("origin <> last")
        .select("print", "window", "origin")
    )
    later = places.join(firsts, ["print", "window"]).filter(F.struct("doc", "first") > F.col("origin"))
    gone = later.groupBy("doc").agg(F.collect_set(F.struct("first", "lines")).alias(gone_runs))
    matched = keyed.join(gone.withColumnRenamed("doc", document), document, "left").select(*docs.columns, gone_runs)

    names = [*docs.drop(removed).columns, removed]
    source = [*docs.columns, gone_runs]
    at = source.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(at).to_pylist(), []
            for row, hits in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                cover: set[int] = set()
                if hits:
                    spans = [(r["first"], r["lines"]) for r in hits]
                    texts[row] = without_lines(texts[row], spans)
                    cover = {k for first, number in spans for k in range(first, first + number)}
                counts.append(len(cover))
            new = {text: pa.array(texts, pa.string()), removed: pa.array(counts, pa.int64())}
            columns = [new[name] if name in new else batch.column(source.index(name)) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = docs.drop(removed).withColumn(removed, F.lit(0).cast("long")).schema
    return matched.mapInArrow(rewrite, schema)


def _batched(make):
    """Joins the small batches that ``make`` yields to ones of some ten thousand rows."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in make(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined
