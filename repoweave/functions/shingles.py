"""Word shingles of a batch of texts as 64-bit digests, and min-hash signatures of them.

Words are runs of bytes other than blanks and line breaks, with A-Z in lower case. A text with fewer words than a shingle has
is one shingle as a whole; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

# Words that are held at once; a single text is never cut.
SLICE_WORDS = 1 << 19

_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def word_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(first row, text of each word, digest of each word, rows)`` for consecutive rows."""
    begin, words, sizes, held = 0, [], [], 0
    for text in texts:
        of_text = words_of(text.as_py())
        words += of_text
        sizes.append(len(of_text))
        held += len(of_text)
        if held >= SLICE_WORDS:
            yield begin, *_digests(words, sizes), len(sizes)
            begin, words, sizes, held = begin + len(sizes), [], [], 0
    if sizes:
        yield begin, *_digests(words, sizes), len(sizes)


def _digests(words: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if not words:
        return owner, np.zeros(0, dtype=np.uint64)
    # pandas' keyed digest of each different word, so that equal words agree everywhere.
    return owner, pd.util.hash_array(np.array(words, dtype=object), categorize=True)


def windows(owner: np.ndarray, words: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and digest of every stretch of ``size`` words within one of ``n`` texts."""
    end = np.searchsorted(owner, np.arange(n + 1))[owner + 1]
    at = np.flatnonzero(end - np.arange(len(owner)) >= size)
    digest = np.zeros(len(at), dtype=np.uint64)
    for i in range(size):
        digest += words[at + i] * _MULTIPLIERS[i] + np.uint64(i)
    return at, scramble(digest)


def shingles(owner: np.ndarray, words: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of ``n`` texts: their text (ascending) and digest (ascending within a text)."""
    at, digest = windows(owner, words, n, size)
    count = np.bincount(owner, minlength=n)
    owners = [owner[at]]
    digests = [digest]
    for short in range(1, size):
        whole = np.flatnonzero(count[owner] == short) if (count == short).any() else np.zeros(0, dtype=int)
        if len(whole):
            at, digest = windows(owner[whole], words[whole], n, short)
            owners.append(owner[whole][at])
            digests.append(scramble(digest + np.uint64(short)))
    owner, digest = np.concatenate(owners), np.concatenate(digests)
    order = np.lexsort((digest, owner))
    owner, digest = owner[order], digest[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
    return owner[new], digest[new]


def signatures(owner: np.ndarray, digest: np.ndarray, n: int, length: int) -> np.ndarray:
    """Smallest values of the shingles of each text under ``length`` orders, 32 bits each; all ones without shingles."""
    out = np.full((n, length), 0xFFFFFFFF, dtype=np.uint32)
    if not len(owner):
        return out
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    seeds = scramble(np.arange(1, length + 1, dtype=np.uint64))
    for i, seed in enumerate(seeds):
        values = ((digest ^ seed) * _MULTIPLIERS[i % 64]) >> np.uint64(32)
        out[owner[first], i] = np.minimum.reduceat(values, first).astype(np.uint32)
    return out
