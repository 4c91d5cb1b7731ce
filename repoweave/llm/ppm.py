"""Prediction by partial matching over byte contexts, with escapes and symbol exclusion, counted on a whole corpus.

A text is its bytes after ORDER zero bytes, and one end symbol. The level ``k`` of the context trie is a sorted array of
paths (``k`` bytes and a symbol) with counts. A symbol is coded in the longest context that has it; each context passed
over on the way costs an escape, and the symbols it holds are excluded below. The escape chance of a context is its number
of symbols that are still possible, over that number plus their counts.

No task holds the trie of the corpus. Texts are taken in blocks; a block asks for the paths and words that it has, by ranges
of keys, and gets their chances and counts back in the same order. What has to be known about a path depends on the last two
bytes of its context alone, except for the levels 0 and 1, which are 257 and 256 * 257 counts at most and go everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.llm.runs import runs
from repoweave.llm.words import Flat, flat_slices, mix, span_hash
from repoweave.session import shared_table

ORDER = 4
SYMBOLS = 257
END = 256
# Text bytes that a range of keys stands for; more text makes more ranges.
RANGE_BYTES = 16 << 20
WORDS, PATHS = 0, 1


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def paths_of(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """The path of every symbol of every text, ``context << 9 | symbol``, and its text."""
    n = flat.n
    size = np.diff(flat.offsets)
    place = flat.offsets[:-1] + np.arange(n) * (ORDER + 1)
    padded = np.zeros(len(flat.data) + n * (ORDER + 1), dtype=np.uint64)
    inside = np.repeat(place + ORDER - flat.offsets[:-1], size) + np.arange(len(flat.data))
    padded[inside] = flat.data
    context = np.zeros(len(padded) - ORDER, dtype=np.uint64)
    for i in range(ORDER):
        context = (context << np.uint64(8)) | padded[i : len(padded) - ORDER + i]
    symbol = padded[ORDER:].copy()
    symbol[place + size] = END
    real = np.ones(len(context), dtype=bool)
    starts = place[1:] - ORDER  # the ORDER places after an end belong to the padding of the next text
    for i in range(ORDER):
        real[starts + i] = False
    return ((context << np.uint64(9)) | symbol)[real], np.repeat(np.arange(n), size + 1)


def words_of(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    low = flat.lower()
    starts, ends = low.words()
    return span_hash(low.prefix_hash(), starts, ends), low.doc_of(starts)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


class Asked:
    """Distinct keys of one kind in a block, with their counts in training texts."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, learn: np.ndarray) -> None:
        known, counts = np.unique(keys[learn], return_counts=True)
        other = np.unique(keys[~learn])
        self.keys += [known, other]
        self.counts += [counts.astype(np.int64), np.zeros(len(other), dtype=np.int64)]
        self.size += len(known) + len(other)
        if self.size > 4 * len(self.keys[0]) + (1 << 20):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            key, count = _summed(self.keys, self.counts)
            self.keys, self.counts, self.size = [key], [count], len(key)
            return key, count
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)


def range_of(kind: int, keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a key: paths by the last two bytes of their context, words by hash."""
    spread = mix((keys >> np.uint64(9)) & np.uint64(0xFFFF)) if kind == PATHS else keys
    return ((spread >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64) * 2 + kind


def _ask(docs: DataFrame, ranges: int) -> DataFrame:
    """``block, part, keys, counts`` of all texts, and a row without a block for the counts of the two lowest levels."""

    def written(block: int, asked: dict[int, Asked]) -> Iterator[pa.RecordBatch]:
        for kind, one in asked.items():
            keys, counts = one.fold()
            part = range_of(kind, keys, ranges)
            order = np.argsort(part, kind="stable")
            keys, counts, part = keys[order], counts[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            pieces = list(zip(cuts, [*cuts[1:], len(part)], strict=True)) if len(part) else []
            for lo in range(0, len(pieces), 64):
                some = pieces[lo : lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some), pa.int64()), pa.array([int(part[a]) for a, _ in some], pa.int64()),
                     pa.array([keys[a:b].tobytes() for a, b in some], pa.binary()),
                     pa.array([counts[a:b].tobytes() for a, b in some], pa.binary())],
                    names=["block", "part", "keys", "counts"],
                )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked = None, {}
        low = np.zeros(256 * SYMBOLS, dtype=np.int64)
        ends = 0
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            learn_rows = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if current != blocks[a]:
                    if asked:
                        yield from written(current, asked)
                    current, asked = int(blocks[a]), {WORDS: Asked(), PATHS: Asked()}
                for lo, hi, flat in flat_slices(batch.column(2).slice(a, b - a)):
                    learn = learn_rows[a + lo : a + hi]
                    words, doc = words_of(flat)
                    asked[WORDS].add(words, learn[doc])
                    paths, doc = paths_of(flat)
                    asked[PATHS].add(paths, learn[doc])
                    seen = paths[learn[doc]]
                    pair = ((seen >> np.uint64(9)) & np.uint64(0xFF)) * np.uint64(SYMBOLS) + (seen & np.uint64(511))
                    low += np.bincount(pair.astype(np.int64), minlength=len(low))
                    ends += int(learn.sum())
        if asked:
            yield from written(current, asked)
        used = np.flatnonzero(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([used.astype(np.uint64).tobytes()], pa.binary()),
             pa.array([low[used].tobytes()], pa.binary())],
            names=["block", "part", "keys", "counts"],
        )

    return docs.select("block", "learn", "text").mapInArrow(scan, "block long, part long, keys binary, counts binary")


def _single_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task, one row each."""
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
            pair = np.frombuffer(keys.as_buffer(), dtype=np.uint64).astype(np.int64)
            n = np.frombuffer(counts.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


class Level:
    """One level of the trie in a range: paths with counts, contexts with total, number of symbols, and the total that
    their symbols have one level below."""

    def __init__(self, paths: np.ndarray, counts: np.ndarray, below: np.ndarray):
        self.paths, self.counts = paths, counts
        contexts = paths >> np.uint64(9)
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(paths) else np.zeros(0, np.int64)
        self.contexts = contexts[first]
        self.total = np.add.reduceat(counts, first) if len(paths) else counts
        self.symbols = np.diff(np.concatenate([first, [len(paths)]]))
        self.lower = np.add.reduceat(below, first) if len(paths) else below

    @staticmethod
    def _find(table: np.ndarray, values: tuple[np.ndarray, ...], keys: np.ndarray) -> list[np.ndarray]:
        if not len(table):
            return [np.zeros(len(keys), dtype=np.int64) for _ in values]
        place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        hit = table[place] == keys
        return [np.where(hit, v[place], 0) for v in values]

    def count(self, paths: np.ndarray) -> np.ndarray:
        return self._find(self.paths, (self.counts,), paths)[0]

    def context(self, paths: np.ndarray) -> list[np.ndarray]:
        return self._find(self.contexts, (self.total, self.symbols, self.lower), paths >> np.uint64(9))


def _cut(paths: np.ndarray, k: int) -> np.ndarray:
    """Paths with their context cut to its last ``k`` bytes."""
    return paths & np.uint64((1 << (8 * k + 9)) - 1)


def log_chances(paths: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 of the chance of each path's symbol after its context.

    ``paths`` are distinct and sorted and hold all paths of the corpus that end in the same two context bytes;
    ``counts`` may be 0; ``low`` has the corpus counts of (last byte, symbol).
    """
    seen = counts > 0
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {ORDER: (paths[seen], counts[seen])}
    for k in range(ORDER - 1, 1, -1):
        tables[k] = _summed([_cut(tables[k + 1][0], k)], [tables[k + 1][1]])
    flat = np.flatnonzero(low)
    tables[1] = ((flat // SYMBOLS).astype(np.uint64) << np.uint64(9) | (flat % SYMBOLS).astype(np.uint64), low[flat])
    tables[0] = _summed([_cut(tables[1][0], 0)], [tables[1][1]])
    levels: dict[int, Level] = {}
    for k in range(ORDER + 1):
        own, n = tables[k]
        below = levels[k - 1].count(_cut(own, k - 1)) if k else np.zeros(len(own), dtype=np.int64)
        levels[k] = Level(own, n, below)
    out = np.zeros(len(paths))
    open_ = np.ones(len(paths), dtype=bool)
    excluded = np.zeros(len(paths), dtype=np.int64)
    excluded_symbols = np.zeros(len(paths), dtype=np.int64)
    for k in range(ORDER, -1, -1):
        cut = _cut(paths, k)
        count = levels[k].count(cut)
        total, symbols, lower = levels[k].context(cut)
        left, left_symbols = total - excluded, symbols - excluded_symbols
        both = np.maximum(left + left_symbols, 1)
        hit = open_ & (count > 0)
        out[hit] += np.log10(count[hit] / both[hit])
        open_ &= ~hit
        escape = open_ & (left_symbols > 0)
        out[escape] += np.log10(left_symbols[escape] / both[escape])
        excluded, excluded_symbols = lower, symbols
    out[open_] -= np.log10(np.maximum(SYMBOLS - excluded_symbols[open_], 1))
    return out


def _answer(asked: DataFrame, low) -> DataFrame:
    """``block, part, keys, values`` for each asking row: corpus counts of words, log10 chances of paths; and, once per
    range, its number of known words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["part"]):
            part = table.column("part")[0].as_py()
            keys = [np.frombuffer(k.as_buffer(), dtype=np.uint64) for k in table.column("keys")]
            counts = [np.frombuffer(c.as_buffer(), dtype=np.int64) for c in table.column("counts")]
            every, total = _summed(keys, counts)
            if part % 2 == PATHS:
                values, known, learned = log_chances(every, total, low.value), 0, 0
            else:
                values, known, learned = total.astype(np.float64), int((total > 0).sum()), int(total.sum())
            for i, (block, own) in enumerate(zip(table.column("block").to_pylist(), keys, strict=True)):
                value = values[np.searchsorted(every, own)].astype(np.float32 if part % 2 == PATHS else np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([part]), pa.array([own.tobytes()], pa.binary()),
                     pa.array([value.tobytes()], pa.binary()), pa.array([0 if i else known]), pa.array([0 if i else learned])],
                    names=["block", "part", "keys", "values", "known", "learned"],
                )

    sorted_ = asked.repartition("part").sortWithinPartitions("part")
    return sorted_.mapInArrow(scan, "block long, part long, keys binary, values binary, known long, learned long")


class Lookup:
    """Values by key, with open addressing. A key that is not there raises."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, first = np.unique(keys, return_index=True)
        self.values = values[first]
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, dtype=np.uint64)
        self.entry = np.full(size, -1, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.entry[slot] < 0
            _, winner = np.unique(slot[free], return_index=True)
            mine = np.flatnonzero(free)[winner]
            self.entry[slot[mine]] = todo[mine]
            self.keys[slot[mine]] = keys[todo[mine]]
            left = np.ones(len(todo), dtype=bool)
            left[mine] = False
            todo, slot = todo[left], (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        miss = np.flatnonzero((self.keys[slot] != keys) & (self.entry[slot] >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            miss = miss[(self.keys[slot[miss]] != keys[miss]) & (self.entry[slot[miss]] >= 0)]
        lost = (self.keys[slot] != keys) | (self.entry[slot] < 0)
        if lost.any():
            raise KeyError(f"{int(lost.sum())} keys have no answer, the first is {int(keys[lost][0])}")
        return self.values[self.entry[slot]]


def score_documents(docs: DataFrame, learn: Column | None = None, block: Column | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``(doc_id, text)``.

    ``score`` is the log10 chance of the text under the model learned from the rows where ``learn`` holds (all rows by
    default); ``base_score`` is that of its words, and one end, by their frequency. ``block`` says which rows share a
    request; by default it is a hash of the id and the text. It should keep neighbours of a file together. It is evaluated
    once and written with the rows, which both passes read, so it may depend on how the table was split for reading.

    A null text is empty: one token, the end. With nothing to learn from, every symbol is equally likely. Repeated rows
    and null ids are scored like any other; an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()
    ranges = max(12, -(-int(total["n"] or 0) // RANGE_BYTES))
    if block is None:
        block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, ranges // 8)))
    rows = shared_table(docs.select(block.alias("block"), learn.alias("learn"), "doc_id", "text"))
    asked = shared_table(_ask(rows, ranges))
    low = np.zeros(256 * SYMBOLS, dtype=np.int64)
    pairs = asked.filter("part = -1").mapInArrow(_single_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    summed = pairs.toArrow()  # at most 256 * 257 rows
    low[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    answers = shared_table(_answer(asked.filter("part >= 0"), spark.sparkContext.broadcast(low)))
    sums = answers.agg(F.sum("known").alias("v"), F.sum("learned").alias("n")).first()
    ends = rows.filter("learn").count()
    tokens, types = int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (1 if ends else 0)
    rest = np.log10(tokens + 0.1 * (types + 1))
    end_base = np.log10(ends + 0.1) - rest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, found = None, {WORDS: [], PATHS: []}, {}

        def take(batch: pa.RecordBatch) -> None:
            for part, key, value in zip(*(batch.column(c) for c in ("part", "keys", "values")), strict=True):
                kind = part.as_py() % 2
                kinds = np.float32 if kind == PATHS else np.float64
                parts[kind].append((np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(value.as_buffer(), kinds)))

        def lookups() -> dict[int, Lookup]:
            out = {}
            for kind, pieces in parts.items():
                pieces = pieces or [(np.zeros(0, np.uint64), np.zeros(0))]
                out[kind] = Lookup(np.concatenate([k for k, _ in pieces]), np.concatenate([v for _, v in pieces]))
                parts[kind] = []
            return out

        for batch in batches:
            block, is_text = batch.column("block").to_numpy(), batch.column("is_text").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                if current != block[a]:
                    current, parts, found = block[a], {WORDS: [], PATHS: []}, {}
                if not is_text[a]:
                    take(batch.slice(a, b - a))
                    continue
                found = found or lookups()
                for lo, hi, flat in flat_slices(batch.column("text").slice(a, b - a)):
                    words, doc = words_of(flat)
                    counts = found[WORDS](words)
                    n_words = np.bincount(doc, minlength=flat.n)
                    base = np.bincount(doc, np.log10(counts + 0.1) - rest, minlength=flat.n) + end_base
                    known = np.bincount(doc[counts > 0], minlength=flat.n) + (1 if ends else 0)
                    paths, doc = paths_of(flat)
                    score = np.bincount(doc, found[PATHS](paths), minlength=flat.n)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(a + lo, hi - lo), pa.array(n_words + 1), pa.array(known),
                         pa.array(np.full(flat.n, tokens)), pa.array(base), pa.array(score)],
                        names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = rows.select(
        "block", F.lit(True).alias("is_text"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("keys"),
        F.lit(None).cast("binary").alias("values"), "doc_id", "text",
    )
    dictionary = answers.select(
        "block", F.lit(False).alias("is_text"), "part", "keys", "values", F.lit(None).cast(id_type).alias("doc_id"),
        F.lit(None).cast("string").alias("text"),
    )
    together = dictionary.union(texts).repartition("block").sortWithinPartitions("block", "is_text")
    schema = f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.mapInArrow(scan, schema)
