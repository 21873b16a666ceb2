"""Benchmark decontamination by an FM-index per training shard.

A shard is a slice of some megabytes of a partition's texts. Its words are numbered by the shard's
own dictionary, texts are parted by a sign of their own, and the index holds the
Burrows-Wheeler transform in a wavelet tree with sampled suffix positions. All
phrases are searched backward at once; their occurrences are located by walking to
the next sampled position, and the spans of a text are merged.

A phrase is a window of ``width`` consecutive words of a benchmark item, or the whole item if
it has fewer, but not none.

Defined cases: null and wordless texts have no words and no hits; null and wordless items have no phrases;
items with equal windows are all reported; repeated rows are judged alike, each for itself;
empty tables give no rows or no hits. Texts are indexed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckspark.llm.common import bound_batches
from deckspark.llm.words import ALPHANUMERIC, Slice, slices, words

WIDTH = 13
#: Every so many-th position of a shard keeps its place in the text.
SAMPLE = 8
#: Phrases that are sent to all tasks at once; more take further passes over the texts.
PHRASES = 200_000
#: Bound in bytes on a block, with its item ids.
BLOCK_BYTES = 64 << 20
SHARD_BYTES = 1 << 20


class Ranks:
    """Counts of set bits before any position, from packed words and one count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Ranks of any symbol in a sequence; one bit row per level, zeros before ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        for level in reversed(range(max(1, int(size - 1).bit_length()))):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            self.levels.append((level, Ranks(bits)))
            ones = bits.astype(bool)
            self.zeros.append(int(len(bits) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        low = np.zeros_like(at)
        for (level, row), zeros in zip(self.levels, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            low_ones, at_ones = row.ones(low), row.ones(at)
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place, and how often it stands before it."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for (level, row), zeros in zip(self.levels, self.zeros, strict=True):
            one = row.bit(at).astype(bool)
            low_ones, at_ones = row.ones(low), row.ones(at)
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
            symbol |= one.astype(symbol.dtype) << level
        return symbol, at - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """All positions in the order of what follows them, by doubling.

    The first sort takes three symbols at once; later ones only positions that still have equals. The
    sequence is cyclic, and the signs between texts, each its own, make an end to all ties.
    """
    n, base = len(symbols), int(symbols.max()) + 1
    key, length = symbols.astype(np.int64), 1
    while base ** (length + 1) < 1 << 62 and length < 3:
        key = key * base + np.roll(symbols, -length)
        length += 1
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    places = np.arange(n)
    # A rank is the place of the first of its equals, so a refined group keeps its own places.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, places, 0))
    while True:
        alone = fresh & np.append(fresh[1:], True)
        places = places[~alone]
        if not len(places):
            return order
        at = order[places]
        key = rank[at] * n + rank[(at + length) % n]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[places] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(fresh, places, 0))
        length *= 2


class FMIndex:
    """Index of the words of some texts, each followed by a sign of its own."""

    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_order(symbols)
        self.first = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=size), out=self.first[1:])
        self.tree = WaveletTree(symbols[order - 1], size)
        marked = order % SAMPLE == 0
        self.marks = Ranks(marked)
        self.samples = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases that occur. Rows are aligned to the right."""
        alive = np.arange(len(phrases))
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.first[-1])
        width = phrases.shape[1]
        for column in reversed(range(width)):
            on = lengths[alive] >= width - column
            symbol = phrases[alive[on], column]
            base = self.first[symbol]
            low[on] = base + self.tree.rank(symbol, low[on])
            high[on] = base + self.tree.rank(symbol, high[on])
            left = low < high
            alive, low, high = alive[left], low[left], high[left]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows of the index, by walking back to sampled ones."""
        out = np.empty(len(rows), np.int64)
        waiting = np.arange(len(rows))
        steps = 0
        while len(waiting):
            here = self.marks.bit(rows).astype(bool)
            out[waiting[here]] = self.samples[self.marks.ones(rows[here])] + steps
            waiting, rows = waiting[~here], rows[~here]
            symbol, before = self.tree.access(rows)
            rows = self.first[symbol] + before
            steps += 1
        return out


class Phrases:
    """A block of phrases as word numbers, aligned to the right, with the items of each."""

    def __init__(self, texts: list[str], items: list[list[str]]):
        parts = [t.split(" ") for t in texts]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        flat = pa.array([w for p in parts for w in p], pa.string()).dictionary_encode()
        self.vocabulary = flat.dictionary
        self.words = np.full((len(parts), max(map(len, parts), default=1)), -1, np.int64)
        ends = np.cumsum(self.lengths)
        column = self.words.shape[1] - np.repeat(ends, self.lengths) + np.arange(len(flat))
        self.words[np.repeat(np.arange(len(parts)), self.lengths), column] = flat.indices.to_numpy()
        self.items = items

    def find(self, part: Slice) -> Iterator[tuple[int, list[list[int]], list[str]]]:
        """(number of words, merged spans of hit words, items) of each text of a slice."""
        own = words(part, ALPHANUMERIC)
        n_docs = len(part)
        counts = np.bincount(own.doc, minlength=n_docs)
        coded = own.arrow().dictionary_encode()
        # Signs 0 to n_docs - 1 end the texts, words have the numbers behind them.
        at = np.arange(len(own.doc)) + own.doc
        symbols = np.empty(len(own.doc) + n_docs, np.int64)
        doc_of = np.repeat(np.arange(n_docs), counts + 1)
        ends = np.cumsum(counts + 1) - 1
        symbols[ends] = np.arange(n_docs)
        symbols[at] = coded.indices.to_numpy() + n_docs
        number = self.vocabulary.to_pandas().map(
            pd.Series(np.arange(len(coded.dictionary)) + n_docs, coded.dictionary.to_pandas())
        ).fillna(-1).to_numpy(np.int64)
        known = np.append(number >= 0, True)[self.words].all(1)
        chosen = np.flatnonzero(known)
        hits: dict[int, set[str]] = {}
        cover = np.zeros(len(symbols) + 1, np.int64)
        if len(chosen):
            index = FMIndex(symbols, n_docs + len(coded.dictionary))
            phrase, low, high = index.search(np.append(number, -1)[self.words[chosen]], self.lengths[chosen])
            if len(phrase):
                many = high - low
                rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                places = index.locate(rows)
                phrase = np.repeat(chosen[phrase], many)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + self.lengths[phrase], -1)
                pairs = np.unique(np.stack([doc_of[places], phrase]), axis=1)
                for doc, p in pairs.T.tolist():
                    hits.setdefault(doc, set()).update(self.items[p])
        hit = np.cumsum(cover[:-1]) > 0
        edges = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        spans: dict[int, list[list[int]]] = {}
        for doc, start, stop in zip(doc_of[starts].tolist(), starts.tolist(), stops.tolist(), strict=True):
            begin = int(ends[doc] - counts[doc])
            spans.setdefault(doc, []).append([start - begin, stop - begin])
        for doc in range(n_docs):
            yield int(counts[doc]), spans.get(doc, []), sorted(hits.get(doc, ()))


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(map(list, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def phrase_table(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(phrase, items): the distinct windows of the items, with all items that have each."""

    def cut_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part in slices(pa.array(batch["text"], pa.string())):
                own = words(part, ALPHANUMERIC)
                names = own.arrow().to_pylist()
                border = np.searchsorted(own.doc, np.arange(len(part) + 1))
                for k in range(len(part)):
                    mine = names[border[k] : border[k + 1]]
                    item = batch["item"].iloc[part.first + k]
                    rows += [(" ".join(mine[i : i + width]), item) for i in range(max(1, len(mine) - width + 1)) if mine]
            yield pd.DataFrame(rows, columns=["phrase", "item"])

    narrow = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    cut = narrow.mapInPandas(cut_items, "phrase string, item string")
    return cut.groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "found",
    width: int = WIDTH,
    block_phrases: int = PHRASES,
) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, spans of hit words (from, to) and item ids as strings.

    Phrases go to the tasks in blocks of bounded size, one pass over the texts for each; passes follow each
    other within the same tasks, so there is no shuffle of texts.
    """
    phrases = phrase_table(items, item_id, item_text, width).persist()
    size = phrases.agg(
        F.count("*"), F.coalesce(F.sum(F.length("phrase") + F.length(F.array_join("items", ",")) + 64), F.lit(0))
    ).first()
    blocks = max(1, -(-size[0] // block_phrases), -(-size[1] // BLOCK_BYTES))
    kind = "struct<n_words:bigint,spans:array<array<int>>,items:array<string>>"
    result = docs.drop(out).withColumn(out, F.lit(None).cast(kind))
    for block in range(blocks):
        rows = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).collect()
        sent = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [list(r[1]) for r in rows]))
        result = _search(result, text, out, sent)
    phrases.unpersist()
    return result


def _search(docs: DataFrame, text: str, out: str, sent) -> DataFrame:
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])
    place = docs.columns.index(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(*sent.value)
        for batch in batches:
            found = []
            for part in slices(batch.column(docs_columns.index(text)), SHARD_BYTES):
                found += [{"n_words": n, "spans": s, "items": i} for n, s, i in phrases.find(part)]
            for row, before in enumerate(batch.column(place).to_pylist()):
                if before is not None:
                    found[row]["spans"] = merge_spans(before["spans"] + found[row]["spans"])
                    found[row]["items"] = sorted({*before["items"], *found[row]["items"]})
            columns = [pa.array(found, kind) if k == place else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(search, docs.schema)


def hit_words(found: str = "found"):
    """Number of words inside any occurrence."""
    return F.aggregate(
        f"{found}.spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long")
    )


def contaminated(found: str = "found"):
    """Whether at least one word is hit, and at least one in twenty."""
    hit = hit_words(found)
    return (hit > 0) & (hit * 20 >= F.col(f"{found}.n_words"))
