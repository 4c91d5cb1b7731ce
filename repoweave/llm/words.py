"""Texts of an Arrow batch as flat bytes, and their words as arrays.

Every operator that reads words goes through here: a word is a maximal run of bytes other than space and tab to carriage
return, which is the code point pattern ``[^\\x20\\x09-\\x0D]+`` because UTF-8 never uses these bytes inside a longer
character. Batches are cut into slices of bounded bytes (a single text is never cut), so memory does not follow the
number of rows of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(13).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the one of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``; tables are kept by the next power of two."""
    return _powers(int(base), max(1 << 16, 1 << int(n).bit_length()))[:n]


def _release() -> None:
    """Free memory goes back to the system, and the tables of powers are dropped."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(step: Step) -> Step:
    """``step`` for ``mapInArrow``, which leaves no free memory in its worker. Spark keeps workers for later tasks, one for each Python
    step that runs at a time, and their allocators would keep what is freed while others are at work."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            _release()

    return run


class Flat:
    """Texts of a slice: ``data`` holds all bytes, text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Flat:
        """With A-Z in lower case."""
        return Flat(LOWER[self.data], self.offsets)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def edges(self) -> np.ndarray:
        """Mask over positions 0..size: where a text begins or ends."""
        mask = np.zeros(len(self.data) + 1, dtype=bool)
        mask[self.offsets] = True
        return mask

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of ``inside`` bytes that do not cross texts."""
        size = len(self.data)
        if not size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        edge = self.edges()
        before = np.empty(size, dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(size, dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~_SEPARATOR[self.data])

    def prefix_hash(self) -> np.ndarray:
        """Running polynomial sums, from which ``span_hash`` takes the hash of any span."""
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * powers(_BASE, len(self.data)), out=out[1:])
        return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(_BASE_INVERSE, len(prefix))[starts])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive word hashes (windows over text borders included)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out += hashes[i : i + m] * _STEP[i]
    return mix(out)


def flat_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Flat]]:
    """``(first row, end row, Flat)`` for slices of at most ``limit`` bytes or one text. Nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = texts.cast(pa.large_binary())
    buffers = wide.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(wide):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(wide))
        yield lo, hi, Flat(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def per_doc_sum(doc: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)
