"""Words of whole Arrow text columns, cut and hashed with numpy.

A batch is worked through in slices of a few megabytes of text, so that memory does not
follow the batch. One very long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: UTF-8 bytes of text that are worked on together.
SLICE_BYTES = 2 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def byte_class(*spans: tuple[int, int], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, byte as it counts) for words of all bytes outside the given spans."""
    inside = np.ones(256, bool)
    for first, last in spans:
        inside[first : last + 1] = False
    as_is = np.arange(256, dtype=np.uint8)
    if lower:
        as_is[ord("A") : ord("Z") + 1] += 32
    return inside, as_is


#: Words without ASCII white space, and words of letters, digits and all beyond ASCII. Bytes of
#: multi-byte characters are 0x80 and up, so byte classes and character classes agree. Fixed values.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
EXACT = byte_class((0x20, 0x20), (0x09, 0x0D), lower=False)
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass
class Slice:
    """Some texts one after the other: byte ``data`` and ``ends`` of n + 1 borders; ``first`` is the first row."""

    first: int
    data: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column, nulls as empty ones."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, borders, values = texts.buffers()
    ends = np.frombuffer(borders, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        yield Slice(row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


@dataclass
class Words:
    """Words of a slice in order: their text's index, and where they start and end in ``data``."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    inside: np.ndarray

    def arrow(self) -> pa.Array:
        """The words as strings."""
        borders = np.zeros(len(self.start) + 1, np.int32)
        np.cumsum(self.end - self.start, out=borders[1:])
        return pa.StringArray.from_buffers(
            len(self.start), pa.py_buffer(borders), pa.py_buffer(self.data[self.inside])
        )

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, alike in all slices."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        power, back = _powers(len(self.data))
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_table()[self.data] * power[: len(self.data)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * back[self.start])


def words(part: Slice, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    """Cuts the texts of a slice into words; no word spans two texts."""
    is_word, as_is = kind
    inside = is_word[part.data]
    if not inside.any():
        none = np.empty(0, np.int64)
        return Words(none, none, none, part.data[:0], inside[:0])
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    borders = part.ends[(part.ends > 0) & (part.ends < len(inside))]
    starts[borders] = inside[borders]
    stops[borders - 1] = inside[borders - 1]
    start = np.flatnonzero(starts)
    return Words(
        np.searchsorted(part.ends, start, "right") - 1, start, np.flatnonzero(stops) + 1, as_is[part.data], inside
    )


def run_hashes(hashes: np.ndarray, first: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Hashes of the runs of ``number`` words that start at the words ``first``; equal runs have equal ones."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    power, back = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mixed((sums[first + number] - sums[first]) * back[first])


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishes 64-bit hashes: each input bit turns about half of the output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@cache
def _table() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


_KEPT: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64; kept for slices of the usual size."""
    if _KEPT and len(_KEPT[0]) >= n:
        return _KEPT[0], _KEPT[1]
    made = []
    for step in (_STEP, _STEP_BACK):
        row = np.full(max(n, SLICE_BYTES), step, np.uint64)
        row[0] = 1
        made.append(np.cumprod(row))
    if n <= SLICE_BYTES:
        _KEPT[:] = made
    return made[0], made[1]
