"""Periodic runs of words, caught online by catchers over dyadic blocks.

A square is a stretch of words followed at once by the same words. For every size ``2 ** k`` the blocks completed so far
that end at a multiple of ``2 ** k`` carry a catcher, which is in charge of periods from ``2 ** k`` to
``2 ** (k + 1) - 1``. A word appended at ``i`` is compared with the last word of the one block per size whose distance lies
in that range, so a word costs one comparison per size. Where both agree, the catcher compares the suffix that ends in its
block with the one that ends at ``i`` backwards, and what follows the block with the words that follow ``i``, now or as they
are appended. As soon as these suffixes cover a whole period, a square is reported; all squares of one period that overlap
are the same run and are merged under its first word.

A square of period ``p`` holds the end of a block of the largest size up to ``p`` in its first half, so none is missed. A
catcher skips comparisons inside a run it knows whose period divides its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_WORDS = 4096
STEPS = 16
RUN = "array<struct<start:long,length:long,period:long>>"


def _grown(array: np.ndarray, size: int, fill: int) -> np.ndarray:
    out = np.full(max(size, 2 * len(array)), fill, dtype=array.dtype)
    out[: len(array)] = array
    return out


class Catchers:
    """Takes words (as numbers) in pieces of any size and knows the maximal runs of all words so far."""

    def __init__(self):
        self.n = 0
        self._words = np.zeros(16, dtype=np.int64)
        self._run_of = np.full(16, -1, dtype=np.int64)  # the last run found over a word
        self._found: dict[tuple[int, int], int] = {}  # (first word, period) -> number of the run
        self._first: list[int] = []
        self._end: list[int] = []
        self._period: list[int] = []
        self._open: dict[tuple[int, int], int] = {}  # suffixes that agree up to the last word: (first, period) -> end

    def append(self, words: np.ndarray) -> None:
        old, new = self.n, self.n + len(words)
        if new > len(self._words):
            self._words = _grown(self._words, new, 0)
            self._run_of = _grown(self._run_of, new, -1)
        self._words[old:new] = words
        self.n = new
        still = self._open
        self._open = {}
        for (first, period), end in still.items():
            self._keep(first, period, self._forwards(end, period))
        k = 0
        while 2 << k <= new:
            self._catch(k, max(old, (2 << k) - 1))
            k += 1

    def _catch(self, k: int, begin: int) -> None:
        """Words from ``begin`` on against the catchers of blocks of ``2 ** k`` words."""
        w, size = self._words, 1 << k
        at = np.arange(begin, self.n)
        block = (((at + 1 - size) >> k) << k) - 1
        hit = np.flatnonzero(w[block] == w[at])
        if not len(hit):
            return
        at, block = at[hit], block[hit]
        run = self._run_of[at]
        if self._first and (run >= 0).any():
            first, period = np.array(self._first)[run], np.array(self._period)[run]
            keep = (run < 0) | (first > block) | ((at - block) % period != 0)
            at, block = at[keep], block[keep]
        period = at - block
        # Suffixes backwards from the block and forwards from it, a few words for all hits at once.
        left, right = np.ones(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        lefts = rights = np.arange(len(at))
        for _ in range(STEPS):
            x = block[lefts] - left[lefts]
            lefts = lefts[(x >= 0) & (w[x] == w[x + period[lefts]])]
            left[lefts] += 1
            x = at[rights] + right[rights] + 1
            inside = x < self.n
            rights, x = rights[inside], x[inside]
            rights = rights[w[x] == w[x - period[rights]]]
            right[rights] += 1
            if not len(lefts) and not len(rights):
                break
        far = np.zeros(len(at), dtype=bool)
        far[lefts] = far[rights] = True
        first, end = block - left + 1, at + right + 1
        near = ~far & ((left + right >= period) | (end == self.n))
        for f, p, e in zip(first[near].tolist(), period[near].tolist(), end[near].tolist(), strict=True):
            self._keep(f, p, e)
        known: dict[int, int] = {}
        for i in np.flatnonzero(far).tolist():
            p = int(period[i])
            if block[i] + p < known.get(p, 0):
                continue
            r = int(self._run_of[at[i]])
            if r >= 0 and self._first[r] <= block[i] and p % self._period[r] == 0:
                continue
            known[p] = self._forwards(int(end[i]), p)
            self._keep(self._backwards(int(first[i]), p), p, known[p])

    def _forwards(self, end: int, period: int) -> int:
        """Where the agreement with the words ``period`` earlier, good up to ``end``, ends."""
        w, step = self._words, 32
        while end < self.n:
            stop = min(end + step, self.n)
            differ = np.flatnonzero(w[end:stop] != w[end - period : stop - period])
            if len(differ):
                return end + int(differ[0])
            end, step = stop, 2 * step
        return end

    def _backwards(self, first: int, period: int) -> int:
        w, step = self._words, 32
        while first > 0:
            start = max(first - step, 0)
            differ = np.flatnonzero(w[start:first] != w[start + period : first + period])
            if len(differ):
                return start + int(differ[-1]) + 1
            first, step = start, 2 * step
        return first

    def _keep(self, first: int, period: int, end: int) -> None:
        """Note an agreement: open while it reaches the last word, a run once it holds a square."""
        if end == self.n:
            self._open[first, period] = end
        if end - first < 2 * period:
            return
        number = self._found.get((first, period))
        if number is None:
            number = self._found[first, period] = len(self._first)
            self._first.append(first)
            self._end.append(first)
            self._period.append(period)
        if end > self._end[number]:
            self._run_of[self._end[number] : end] = number
            self._end[number] = end

    def runs(self, min_exponent: int = 2, min_words: int = 2) -> list[tuple[int, int, int]]:
        """``(start, length, smallest period)`` of the maximal runs, by start and period."""
        least: dict[tuple[int, int], int] = {}
        for first, end, period in zip(self._first, self._end, self._period, strict=True):
            if period < least.get((first, end), period + 1):
                least[first, end] = period
        return sorted(
            (first, end - first, period)
            for (first, end), period in least.items()
            if end - first >= max(min_words, min_exponent * period)
        )


def runs_of(words: list[str], min_exponent: int = 2, min_words: int = 2) -> list[tuple[int, int, int]]:
    """Runs of one text."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], dtype=np.int64)
    catchers = Catchers()
    for i in range(0, len(ids), CHUNK_WORDS):
        catchers.append(ids[i : i + CHUNK_WORDS])
    return catchers.runs(min_exponent, min_words)


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that any run repeats, that is, contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    covered = np.cumsum(change)
    return [word for word, dropped in zip(words, covered[:-1].tolist(), strict=True) if not dropped]


def find_runs(docs: DataFrame, min_exponent: int = 4, min_words: int = 6) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``(doc_id, text)``; ``runs`` holds ``start, length, period`` by
    start and period, ``collapsed`` the words that no run repeats, joined by one space.

    A run is a stretch of words with smallest period ``period`` and at least ``min_exponent`` (2 or more) times that many
    words, and ``min_words`` of them, that no neighbouring word extends. A null, empty or blank text has no words, no runs
    and an empty ``collapsed``; every row is by itself, so repeated rows and ids (null ones too) give repeated results; an
    empty table gives no rows. Other columns are not looked at. No shuffle: memory follows the longest text.
    """
    if min_exponent < 2:
        raise ValueError("a run holds at least a square")
    pattern = re.compile(WORD)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, rest = [], [], []
            for text in batch.column(1):
                words = pattern.findall(text.as_py() or "")
                runs = runs_of(words, min_exponent, min_words)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                rest.append(" ".join(collapse(words, runs)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(rest, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {id_type}, n_words long, runs {RUN}, collapsed string"
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the words of each text joined by one space; where crc32 of the decimal id ends in 0, the words
    from some place on repeat the first ones from there. Known runs for tests and checks. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), h.alias("h"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = words.select("doc_id", "words", "h", (g % F.greatest(n, F.lit(1))).cast("int").alias("a"), (3 + g % 8).alias("times"))
    rest = n - F.col("a")
    cycle = F.slice("words", F.col("a") + 1, (1 + F.floor(rest / F.col("times"))).cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(cycle, F.col("times").cast("int") + 1)), F.lit(1), rest)
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), repeated)
    chosen = F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("words"))
    return placed.select("doc_id", F.array_join(chosen, " ").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each row (ties: smallest start, then period) and digests of all its runs and of what is left."""
    order = F.array_sort(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get(order, 0)
    start, length, period = best["start"], -best["col1"], best["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
