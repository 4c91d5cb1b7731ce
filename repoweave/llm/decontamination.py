"""Benchmark decontamination: a BM25 index of test items, searched by every passage of every document.

Index terms are pairs of neighbouring words, which unrelated texts seldom share, so nearly all passages fail the first
bound. Items are indexed in chunks, so that a long item is found by any stretch of it. Scores are divided by the score that a
chunk has for its own words: 1 is the chunk itself, and one threshold fits all. A passage retrieves every chunk at or above
the threshold by block-max WAND. A hit is verified around the passages that retrieved the item, by shares of pairs of words in
order: of the question (all sentences but the last), of the answer (the last one), and of the retrieved chunk alone, so that a
stretch of a long item is a leak as well. A changed word breaks two pairs.

Document frequencies and the mean length are those of all chunks, counted on Spark, and scores are sums without rounding on
the way, so that rows and scores are the same for any number of indexes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.words import Flat, flat_slices, grams, span_hash
from repoweave.session import shared_checkpoint, shared_table

K1, B = 1.2, 0.75
CHUNK_TERMS = 48
THRESHOLD = 0.5
QUESTION_SHARE, ANSWER_SHARE, QUESTION_ALONE, CHUNK_SHARE = 0.5, 0.5, 0.7, 0.8
POSTING_BLOCK = 32
# Items and bytes of text of one index, which is broadcast; more make more indexes, each searched in a scan of its own. An item
# is never divided.
SHARD_ITEMS = 20_000
SHARD_BYTES = 16 << 20

_TERM = np.zeros(256, dtype=bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of terms (runs of letters and digits, A-Z in lower case) and the text of each."""
    low = flat.lower()
    starts, ends = low.runs(_TERM[low.data])
    return span_hash(low.prefix_hash(), starts, ends), low.doc_of(starts)


def _terms_of(texts: list[str]) -> list[np.ndarray]:
    _, _, flat = next(flat_slices(pa.array(texts, pa.string()), 1 << 40))
    hashes, doc = terms(flat)
    return np.split(hashes, np.searchsorted(doc, np.arange(1, len(texts))))


def pairs(sequence: np.ndarray) -> np.ndarray:
    """Index terms of a sequence of words: its pairs of neighbours, or the one word it has."""
    return grams(sequence, 2) if len(sequence) > 1 else grams(sequence, 1)


def _known(sequence: np.ndarray) -> np.ndarray:
    """What the pairs of an item are looked up in: pairs, and words for items and questions of a single one."""
    return np.concatenate([grams(sequence, 1), grams(sequence, 2)])


def _chunks(sequence: np.ndarray) -> list[np.ndarray]:
    """Pairs of each chunk of an item's words."""
    return [pairs(part) for part in np.array_split(sequence, math.ceil(len(sequence) / CHUNK_TERMS))] if len(sequence) else []


@dataclass
class Item:
    """An item with the pairs of its question and those that reach into its answer."""

    item_id: object
    question: np.ndarray
    answer: np.ndarray


def make_item(item_id: object, text: str) -> tuple[Item, np.ndarray]:
    """The item and all its terms. A single sentence is question and answer at once."""
    cut = [m.end() for m in re.finditer(r"[.?!\n]+\s+(?=\S)", text.strip())]
    head, tail = (text.strip()[: cut[-1]], text.strip()[cut[-1] :]) if cut else (text, "")
    first, last = _terms_of([head, tail])
    joined = np.concatenate([first, last])
    if not len(first) or not len(last):
        return Item(item_id, pairs(joined), pairs(joined)), joined
    return Item(item_id, pairs(first), pairs(joined[len(first) - 1 :])), joined


@dataclass
class Statistics:
    """Number of chunks, their mean number of pairs, and the number of chunks that hold a pair."""

    n: int
    mean: float
    df: dict[int, int]

    @classmethod
    def of(cls, chunks: list[np.ndarray]) -> Statistics:
        df = Counter(t for c in chunks for t in set(c.tolist()))
        return cls(len(chunks), sum(map(len, chunks)) / max(1, len(chunks)), df)


class Index:
    """Postings by term in chunk order, with the largest impact per term and per block of postings."""

    def __init__(self, items: Iterable[tuple[object, str]], statistics: Statistics | None = None):
        self.items: list[Item] = []
        self.chunks: list[np.ndarray] = []
        owner: list[int] = []
        for item_id, text in items:
            item, sequence = make_item(item_id, text)
            if not len(sequence):
                continue
            self.items.append(item)
            parts = _chunks(sequence)
            self.chunks += parts
            owner += [len(self.items) - 1] * len(parts)
        self.owner = np.array(owner, dtype=np.int64)
        known = statistics or Statistics.of(self.chunks)
        rows = []
        for chunk, own_pairs in enumerate(self.chunks):
            norm = K1 * (1 - B + B * len(own_pairs) / known.mean)
            impact = {
                t: math.log(1 + (known.n - known.df[t] + 0.5) / (known.df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                for t, tf in Counter(own_pairs.tolist()).items()
            }
            own = math.fsum(impact.values())
            rows += [(t, chunk, i / own) for t, i in impact.items()]
        rows.sort()
        term = np.array([r[0] for r in rows], dtype=np.uint64)
        self.terms, first = np.unique(term, return_index=True)
        self.starts = np.concatenate([first, [len(rows)]]).astype(np.int64)
        self.chunk = np.array([r[1] for r in rows], dtype=np.int64)
        self.impact = np.array([r[2] for r in rows])
        self.top = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(rows) else np.zeros(0)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        self.lists: dict[int, tuple] = {}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term in the index, -1 for others."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.terms):
            some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.terms, hashes[some]), len(self.terms) - 1)
            hit = self.terms[place] == hashes[some]
            out[some[hit]] = place[hit]
        return out

    def _list(self, term: int) -> tuple[list[int], list[float], list[int], list[float]]:
        """Chunks and impacts of a term; last chunk and largest impact of each block."""
        if term not in self.lists:
            lo, hi = self.starts[term], self.starts[term + 1]
            chunk, impact = self.chunk[lo:hi].tolist(), self.impact[lo:hi].tolist()
            cuts = range(0, hi - lo, POSTING_BLOCK)
            self.lists[term] = (
                chunk, impact,
                [chunk[min(c + POSTING_BLOCK, len(chunk)) - 1] for c in cuts],
                [max(impact[c : c + POSTING_BLOCK]) for c in cuts],
            )
        return self.lists[term]

    def search(self, query: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All chunks whose score for the distinct terms of ``query`` reaches ``threshold``, by block-max WAND."""
        lists = [self._list(t) for t in query]
        tops = [float(self.top[t]) for t in query]
        at = [0] * len(query)
        slack = threshold - 1e-9
        found = []
        live = list(range(len(query)))

        def forward(c: int, target: int) -> None:
            at[c] = bisect_left(lists[c][0], target, at[c])

        while live:
            live = [c for c in live if at[c] < len(lists[c][0])]
            live.sort(key=lambda c: lists[c][0][at[c]])
            total, pivot = 0.0, -1
            for k, c in enumerate(live):
                total += tops[c]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return found
            chunk = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == chunk:
                pivot += 1
            ahead = live[: pivot + 1]
            bound, border = 0.0, None
            for c in ahead:
                block = bisect_left(lists[c][2], chunk)
                if block < len(lists[c][2]):
                    bound += lists[c][3][block]
                    border = lists[c][2][block] if border is None else min(border, lists[c][2][block])
            if bound < slack:
                # No chunk up to the nearest block border or the next list's chunk can reach the threshold.
                target = chunk + 1 if border is None else border + 1
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                for c in ahead:
                    forward(c, max(target, chunk + 1))
            elif lists[ahead[0]][0][at[ahead[0]]] == chunk:
                score = math.fsum(lists[c][1][at[c]] for c in ahead)
                if score >= slack:
                    found.append((chunk, score))
                for c in ahead:
                    at[c] += 1
            else:
                for c in ahead:
                    forward(c, chunk)
        return found


def passages(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping passages of two chunk lengths of terms, one chunk length apart, as ranges over the terms."""
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)
    count = np.maximum(1, np.ceil(size / CHUNK_TERMS).astype(np.int64) - 1) * (size > 0)
    of = np.repeat(np.arange(n), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = first[of] + step * CHUNK_TERMS
    return starts, np.minimum(starts + 2 * CHUNK_TERMS, first[of + 1])


Hit = tuple[int, int, float, float, float, float]  # text, item, score, shares of question, answer and one chunk


def leaks(flat: Flat, index: Index, threshold: float = THRESHOLD) -> list[Hit]:
    """Verified leaks of a slice: retrieval per passage, then shares of pairs around the passages that retrieved."""
    hashes, doc = terms(flat)
    if not len(hashes):
        return []
    number = np.full(len(hashes), -1, dtype=np.int64)
    number[:-1] = np.where(doc[1:] == doc[:-1], index.lookup(grams(hashes, 2)), -1)
    alone = np.bincount(doc, minlength=flat.n)[doc] == 1
    number[alone] = index.lookup(grams(hashes[alone], 1))
    known_terms = np.flatnonzero(number >= 0)
    top = np.zeros(len(hashes) + 1)
    top[known_terms + 1] = index.top[number[known_terms]]
    np.cumsum(top, out=top)
    starts, ends = passages(doc, flat.n)
    best: dict[tuple[int, int], float] = {}
    chunk_share: dict[tuple[int, int], float] = {}
    around: dict[tuple[int, int], list[np.ndarray]] = {}
    first = np.searchsorted(doc, np.arange(flat.n + 1))
    # A passage whose terms cannot reach the threshold even with their largest impacts has no pivot at all.
    for k in np.flatnonzero(top[ends] - top[starts] >= threshold - 1e-6):
        own = np.unique(number[starts[k] : ends[k]])
        own = own[own >= 0]
        if index.top[own].sum() < threshold - 1e-6:
            continue
        text = int(doc[starts[k]])
        found = index.search(own.tolist(), threshold)
        if found:
            lo, hi = max(first[text], starts[k] - CHUNK_TERMS), min(first[text + 1], ends[k] + CHUNK_TERMS)
            near = _known(hashes[lo:hi])
        for chunk, score in found:
            key = (text, int(index.owner[chunk]))
            best[key] = max(best.get(key, 0.0), score)
            chunk_share[key] = max(chunk_share.get(key, 0.0), _share(index.chunks[chunk], near))
            around.setdefault(key, []).append(near)
    out = []
    for (text, item), score in sorted(best.items()):
        near = np.concatenate(around[text, item])
        question, answer = _share(index.items[item].question, near), _share(index.items[item].answer, near)
        part = chunk_share[text, item]
        if question >= QUESTION_ALONE or (question >= QUESTION_SHARE and answer >= ANSWER_SHARE) or part >= CHUNK_SHARE:
            out.append((text, item, score, question, answer, part))
    return out


def _share(wanted: np.ndarray, known: np.ndarray) -> float:
    return float(np.isin(wanted, known).mean())


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shard, term, size``: a row for each pair of each chunk, and one with the size of the chunk."""
    for batch in batches:
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for chunk in _chunks(make_item(None, text)[1]):
                own = np.unique(chunk).view(np.int64)
                terms_, sizes = [*own.tolist(), None], [None] * len(own) + [len(chunk)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(sizes), pa.int64()), pa.array(terms_, pa.int64()), pa.array(sizes, pa.int64())],
                    names=["shard", "term", "size"],
                )


def indexes(benchmark: DataFrame, shard_items: int = SHARD_ITEMS, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """Indexes of at most about ``shard_items`` items and ``shard_bytes`` bytes of text each, by a hash of the item. Null or blank
    items are left out."""
    items = benchmark.filter("text is not null").select("item_id", "text").distinct()
    items, seen = shared_checkpoint(items, n=F.count(F.lit(1)), size=F.sum(F.octet_length("text")))
    if not seen["n"]:
        return
    shards = max(math.ceil(seen["n"] / shard_items), math.ceil(seen["size"] / shard_bytes))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    rows = items.select("shard", "text").mapInArrow(_pair_rows, "shard long, term long, size long")
    rows, every = shared_table(rows, n=F.count("size"), pairs=F.sum("size"))
    counted = shared_table(rows.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    for shard in range(shards):
        mine = counted.join(rows.filter(F.col("shard") == shard), "term", "left_semi")
        df = {r.term & (1 << 64) - 1: r.df for r in mine.toLocalIterator()}
        texts = items.filter(F.col("shard") == shard).toLocalIterator()
        if df:
            ordered = sorted(((r.item_id, r.text) for r in texts), key=lambda r: (r[0] is None, r))
            yield Index(ordered, Statistics(every["n"], every["pairs"] / every["n"], df))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    shard_items: int = SHARD_ITEMS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Verified leaks ``doc_id, item_id, score, question_overlap, answer_overlap, part_overlap``, one row per document and item;
    the last is the share of that chunk of the item which is found best.

    Documents without a leak have no row, and neither have null or blank texts. Repeated documents each get their rows.
    An empty benchmark or table gives no rows; other columns are not looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType
    measures = ["score", "question_overlap", "answer_overlap", "part_overlap"]
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, " + ", ".join(f"{c} double" for c in measures)
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, shard_items, shard_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, flat in flat_slices(batch.column(1)):
                    hits = leaks(flat, shared.value, threshold)
                    if hits:
                        rows = pa.array([lo + h[0] for h in hits], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), pa.array([shared.value.items[h[1]].item_id for h in hits]),
                             *[pa.array([h[i] for h in hits], pa.float64()) for i in (2, 3, 4, 5)]],
                            names=["doc_id", "item_id", *measures],
                        )

        out = out.union(docs.select("doc_id", "text").mapInArrow(scan, schema))
    return out


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    shard_items: int = SHARD_ITEMS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The rows of ``docs`` without a verified leak, all columns as they are. Rows are judged one by one."""
    for index in indexes(benchmark, shard_items, shard_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, at=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {lo + h[0] for lo, _, flat in flat_slices(batch.column(at)) for h in leaks(flat, shared.value, threshold)}
                if bad:
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[list(bad)] = False
                    batch = batch.filter(pa.array(keep))
                yield batch

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
