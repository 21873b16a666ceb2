"""Removal of repeated passages of running text, by winnowing over word runs.

A word is removed if it lies in a run of ``run_words`` words that stood before, in the order of (doc_id, word number),
wherever lines break and whatever words stand around it. Words are cut at ASCII white space and compared as they are.

Each run of ``run_words`` words selects the least hash of the ``GRAM`` word runs in it (a window minimum); equal
runs select equal minima. One row is stored for each place of a minimum, with the hash of its stretch: all words of the
runs that selected it. A stretch that stood before goes whole. First places of stretches are dropped if no other
stretch has their minimum; the runs in the others are hashed one by one and joined to their first occurrence.
Matched runs that overlap are one passage, which so extends both ways word by word as far as the texts agree.

The result is exact: a word goes if and only if it lies in such a run that occurred earlier.

Defined cases: null stays null; white space behind a removed passage goes with it; rows that repeat
both id and text are one document and get the same result; null ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckspark.llm.common import bound_batches, cut, free_name
from deckspark.llm.lines import RUN_WORDS, _batched
from deckspark.llm.words import EXACT, Slice, Words, mixed, run_hashes, slices, words
from deckspark.operators.skew import fits_broadcast

#: Words of the runs whose hashes are compared first, at most half of a passage.
GRAM = 25


def selected(part: Slice, run_words: int) -> tuple[Words, *tuple[np.ndarray, ...]]:
    """(words, their hashes, number of each in its text, selected short runs, and of each the first run and number of runs)."""
    own = words(part, EXACT)
    number = np.arange(len(own.doc)) - np.searchsorted(own.doc, own.doc)
    hashes = own.hashes()
    none = np.empty(0, np.int64)
    if len(hashes) < run_words:
        return own, hashes, number, none.view(np.uint64), none, none, none
    gram = max(1, min(GRAM, run_words // 2))
    grams = run_hashes(hashes, np.arange(len(hashes) - gram + 1), gram)
    runs = np.arange(len(hashes) - run_words + 1)
    picks = runs + np.lib.stride_tricks.sliding_window_view(grams, run_words - gram + 1).argmin(1)
    inside = own.doc[runs] == own.doc[runs + run_words - 1]
    at, first, count = np.unique(picks[inside], return_index=True, return_counts=True)
    return own, hashes, number, grams[at], at, runs[inside][first], count


def drop_repeated_passages(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run_words: int = RUN_WORDS, removed: str = "n_removed"
) -> DataFrame:
    """``docs`` with repeated passages removed from its texts, and the number of words that went."""
    bound_batches(docs.sparkSession)
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    document, gone_runs = free_name(docs, "_doc"), free_name(docs, "_gone")
    places_in = free_name(docs, "_at")
    keyed = docs.withColumn(document, key)
    kind = keyed.schema[document].dataType.simpleString()

    def with_lists(lists: DataFrame, how: str) -> DataFrame:
        lists = cut(lists)
        return keyed.join(F.broadcast(lists) if fits_broadcast(lists) else lists, document, how)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                own, hashes, number, prints, at, first, count = selected(part, run_words)
                # Equal stretches have their minimum at the same place, so equal runs in them.
                stretch = run_hashes(hashes, first, count + run_words - 1) if len(first) else prints
                stretch = mixed(stretch * np.uint64(1 << 16 | 1) + (at - first).astype(np.uint64) + (count << 32).astype(np.uint64))
                columns = [prints.view(np.int64), stretch.view(np.int64), number[first].astype(np.int32), count.astype(np.int32)]
                doc = batch.column(0).take(pa.array(part.first + own.doc[first]))
                yield pa.RecordBatch.from_arrays([doc, *map(pa.array, columns)], ["doc", "print", "stretch", "first", "runs"])

    texts = keyed.select(F.col(document).alias("_doc"), F.col(text).alias("_text"))
    places = cut(texts.mapInArrow(_batched(minima), f"doc {kind}, print bigint, stretch bigint, first int, runs int"))
    place = F.struct("doc", "first", "runs")
    # The first place of each stretch; a third of all rows may share one, so it is a partial minimum.
    firsts = cut(places.groupBy("print", "stretch").agg(F.min(place).alias("origin"), F.max(place).alias("last")))
    copied = firsts.filter("origin <> last").select("print", "stretch", "origin")
    whole = places.join(copied, ["print", "stretch"]).filter(place > F.col("origin")).select(place.alias("p"))
    again = firsts.groupBy("print").count().filter("count > 1").select("print")
    opened = firsts.join(again, "print").select("origin.*").groupBy("doc")
    asked = opened.agg(F.collect_list(F.struct("first", "runs")).alias(places_in)).withColumnRenamed("doc", document)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                own = words(part, EXACT)
                lists = batch.column(2).slice(part.first, len(part))
                owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                first, count = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
                count_before = np.cumsum(count) - count
                within = np.repeat(first - count_before, count) + np.arange(count.sum())
                row = np.repeat(owner, count)
                start = np.searchsorted(own.doc, row) + within
                columns = [run_hashes(own.hashes(), start, run_words).view(np.int64), within.astype(np.int32)]
                doc = batch.column(0).take(pa.array(part.first + row))
                yield pa.RecordBatch.from_arrays([doc, *map(pa.array, columns)], ["doc", "window", "first"])

    open_texts = with_lists(asked, "inner").select(F.col(document).alias("_doc"), F.col(text).alias("_text"), F.col(places_in))
    found = cut(open_texts.mapInArrow(_batched(runs), f"doc {kind}, window bigint, first int"))
    origins = (
        found.groupBy("window")
        .agg(F.min(F.struct("doc", "first")).alias("origin"), F.max(F.struct("doc", "first")).alias("last"))
        .filter("origin <> last")
        .select("window", "origin")
    )
    later = found.join(origins, "window").filter(F.struct("doc", "first") > F.col("origin"))
    single = later.select(F.struct("doc", "first", F.lit(1).alias("runs")).alias("p"))
    gone = whole.union(single).select("p.*").groupBy("doc").agg(F.collect_list(F.struct("first", "runs")).alias(gone_runs))
    gone = gone.withColumnRenamed("doc", document)
    matched = with_lists(gone, "left").select(*docs.columns, gone_runs)
    source, names = [*docs.columns, gone_runs], [*docs.drop(removed).columns, removed]
    at = source.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, counts = batch.column(at).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for row, starts in enumerate(batch.column(batch.num_columns - 1)):
                if starts.is_valid:
                    new[row], counts[row] = without_runs(new[row], *(c.to_numpy() for c in starts.values.flatten()), run_words)
            made = {text: pa.array(new, pa.string()), removed: pa.array(counts)}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(source.index(n)) for n in names], names)

    return matched.mapInArrow(rewrite, docs.drop(removed).withColumn(removed, F.lit(0).cast("long")).schema)


def without_runs(text: str, starts: np.ndarray, runs: np.ndarray, run_words: int) -> tuple[str, int]:
    """The text without the given numbers of runs that start at the given words and the next, and how many words went."""
    data = text.encode()
    own = words(Slice(0, np.frombuffer(data, np.uint8), np.array([0, len(data)])), EXACT)
    step = np.zeros(len(own.start) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + runs - 1 + run_words, -1)
    drop = np.diff((np.cumsum(step[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    kept, done = [], 0
    for a, b in zip(np.flatnonzero(drop > 0), np.flatnonzero(drop < 0), strict=True):
        kept.append(data[done : own.start[a]])
        done = own.start[b] if b < len(own.start) else own.end[b - 1]
    return b"".join([*kept, data[done:]]).decode(), int((np.cumsum(step[:-1]) > 0).sum())
