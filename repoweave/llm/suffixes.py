"""Removal of repeated byte strings by maximal repeats of an enhanced suffix array.

Every string of LENGTH bytes holds one anchor, the K-byte piece with the smallest hash (of equal ones the first). Windows
that follow each other with the same anchor form a segment, and equal windows lie in segments of equal anchors, so the
suffix array falls into buckets by anchor that never have to be compared with each other.

Segments whose anchor occurs once hold no repeat. Equal segments enter their bucket once, with their number; a bucket of
one distinct segment is a maximal repeat as it stands. In all other buckets the suffixes are sorted by prefix doubling, the
common-prefix intervals are found by a stack scan, and intervals of LENGTH bytes or more whose occurrences differ in the
byte before them (or begin a segment) are the maximal repeats: the group of all their occurrences is covered.

A bucket above ``bucket_bytes`` is split by what a suffix begins with: its windows are counted by a digest of LENGTH bytes,
combined before the shuffle, which is the interval of depth LENGTH taken by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.runs import runs
from repoweave.llm.words import Flat, flat_slices, span_hash
from repoweave.session import shared_table

LENGTH = 200
K = 16
BUCKET_BYTES = 4 << 20
BATCH_BYTES = 1 << 19
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def segments(flat: Flat, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a slice as ``text, start, end, anchor``, in bytes of the slice. Texts below ``length`` have none."""
    none = np.zeros(0, dtype=np.int64)
    size = len(flat.data)
    width = length - K + 1
    if size < length or not (np.diff(flat.offsets) >= length).any():
        return none, none, none, none.astype(np.uint64)
    starts = np.arange(size - K + 1)
    hashes = span_hash(flat.prefix_hash(), starts, starts + K)
    anchors = np.empty(size - length + 1, dtype=np.int64)
    # Positions are packed below the hash, so texts are taken in stretches that fit the packed bits.
    stretch = (1 << _PLACE_BITS) - length
    for lo in range(0, len(anchors), stretch):
        hi = min(lo + stretch, len(anchors))
        part = hashes[lo : hi + width - 1]
        packed = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        anchors[lo:hi] = lo + (_sliding_minimum(packed, width)[: hi - lo] & _PLACE).astype(np.int64)
    window = np.arange(len(anchors))
    text = flat.doc_of(window)
    valid = window + length <= flat.offsets[text + 1]
    window, text, anchor = window[valid], text[valid], anchors[valid]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(window)]]) - 1
    return text[first], window[first], window[last] + length, hashes[anchor[first]]


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, from minima towards both ends of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class SuffixArray:
    """Sorted suffixes of many strings, with common prefixes of adjacent ones. Strings end in borders that equal nothing.

    Suffixes are sorted by their first 8 bytes, then by prefix doubling; each round sorts only those that still share their
    group with others. A suffix of fewer than 8 bytes is a group of its own, so no comparison goes on over a border.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size = n = int(sizes.sum())
        self.bytes = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        self.string = np.repeat(np.arange(len(strings)), sizes)
        self.ends = self.starts + sizes - 1
        padded = np.concatenate([self.bytes, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
        packed = np.zeros(n, dtype=np.uint64)
        for i in range(8):
            packed = (packed << np.uint64(8)) | padded[i : n + i]
        room = self.ends[self.string] - np.arange(n)
        short, long = np.flatnonzero(room < 8), np.flatnonzero(room >= 8)
        long = long[np.argsort(packed[long])]
        # What reaches over a border counts as zero bytes; a shorter suffix stands before longer ones of the same bytes.
        kept = packed[short] & (~np.uint64(0) << (np.uint64(64) - 8 * room[short].astype(np.uint64))) * (room[short] > 0)
        by_bytes = np.lexsort((room[short], kept))
        at = np.searchsorted(packed[long], kept[by_bytes])
        self.order = np.insert(long, at, short[by_bytes])
        ordered = packed[self.order]
        first = np.ones(n, dtype=bool)
        first[1:] = (ordered[1:] != ordered[:-1]) | (room[self.order[1:]] < 8) | (room[self.order[:-1]] < 8)
        place = np.arange(n)
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(first, place, 0))
        step, longest = 8, int(sizes.max())
        self.ranks = [(step, rank.copy())]
        while step < longest:
            several = np.flatnonzero(~(first & np.append(first[1:], True)))
            if not len(several):
                break
            sub = self.order[several]
            key = (rank[sub] << 32) | rank[sub + step]
            order = np.argsort(key)
            key = key[order]
            self.order[several] = sub[order]
            first[several] = np.concatenate([[True], key[1:] != key[:-1]])
            rank[self.order[several]] = np.maximum.accumulate(np.where(first, place, 0))[several]
            step *= 2
            self.ranks.append((step, rank.copy()))

    def common_prefixes(self, length: int) -> np.ndarray:
        """Length of the common prefix of each suffix with the one before it in the order, 0 for those below ``length``."""
        out = np.zeros(self.size, dtype=np.int64)
        enough = [rank for step, rank in self.ranks if step <= length][-1]
        pair = np.flatnonzero(enough[self.order[1:]] == enough[self.order[:-1]])
        a, b = self.order[pair].copy(), self.order[pair + 1].copy()
        total = np.zeros(len(pair), dtype=np.int64)
        again = True
        while again:
            again = False
            for step, rank in reversed(self.ranks):
                same = rank[a] == rank[b]
                a[same] += step
                b[same] += step
                total[same] += step
                again |= bool(same.any()) and step == self.ranks[-1][0]
        for _ in range(7):  # what is left is shorter than 8 bytes; a border equals no byte
            same = (self.bytes[a] == self.bytes[b]) & (a != self.ends[self.string[a]]) & (b != self.ends[self.string[b]])
            a[same] += 1
            b[same] += 1
            total[same] += 1
        out[pair + 1] = np.where(total >= length, total, 0)
        return out

    def before(self, at: np.ndarray) -> np.ndarray:
        """What stands before each place: a byte, or a value of its own at the beginning of a string."""
        return np.where(at == self.starts[self.string[at]], 256 + at, self.bytes[at - 1].astype(np.int64))


def maximal_repeats(array: SuffixArray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """Maximal repeats of ``length`` or more as ``(length, places of all occurrences)``.

    A stack scan over the common prefixes finds every interval. An interval is kept if its occurrences do not all follow
    the same byte. The places of an interval include those of the intervals inside it.
    """
    common = array.common_prefixes(length)
    order = array.order
    deep = common >= length
    if not deep.any():
        return
    left = array.before(order).tolist()
    depths = common.tolist()
    edges = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        # Suffixes lo - 1 .. hi - 1 share at least ``length`` bytes; the intervals inside are nested by depth.
        values, marks = depths[lo:hi], left[lo - 1 : hi]
        stack: list[list] = []  # depth, first suffix, mark that all share (None: they differ)

        def close(item: list, end: int) -> tuple[int, np.ndarray] | None:
            depth, first, mark = item
            return (depth, order[lo - 1 + first : lo + end]) if mark is None else None

        for i, depth in enumerate(values):
            first, mark = i, marks[i]
            while stack and stack[-1][0] > depth:
                item = stack.pop()
                found = close(item, i)
                if found:
                    yield found
                first = item[1]
                mark = item[2]
                if stack and stack[-1][0] >= depth:
                    stack[-1][2] = mark if stack[-1][2] == mark else None
            if stack and stack[-1][0] == depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == marks[i + 1] else None
            else:
                stack.append([depth, first, mark if mark == marks[i + 1] else None])
        while stack:
            item = stack.pop()
            found = close(item, len(values))
            if found:
                yield found
            if stack:
                stack[-1][2] = item[2] if stack[-1][2] == item[2] else None


def repeat_groups(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of a few texts: ``(length, [(text, start), ...])`` with all occurrences."""
    array = SuffixArray(texts)
    groups = []
    for depth, places in maximal_repeats(array, length):
        owner = array.string[places]
        groups.append((depth, sorted(zip(owner.tolist(), (places - array.starts[owner]).tolist(), strict=True))))
    return groups


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _covered(strings: list[bytes], weights: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Covered spans of each string. Strings that stand for several occurrences are covered whole."""
    array = SuffixArray(strings)
    marks = np.zeros(array.size + 1, dtype=np.int64)
    for depth, places in maximal_repeats(array, length):
        ends = np.minimum(places + depth, array.ends[array.string[places]])
        np.add.at(marks, places, 1)
        np.add.at(marks, ends, -1)
    inside = np.cumsum(marks) > 0
    inside[array.ends] = False
    border = np.flatnonzero(np.diff(np.concatenate([[False], inside[: array.size], [False]]).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[(0, len(s))] if w > 1 else [] for s, w in zip(strings, weights, strict=True)]
    for a, b in zip(border[::2].tolist(), border[1::2].tolist(), strict=True):
        k = int(array.string[a])
        if weights[k] == 1:
            out[k].append((a - int(array.starts[k]), b - int(array.starts[k])))
    return out


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, digest, text_key, start, size`` of all segments."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, flat in flat_slices(batch.column(1)):
                text, start, end, anchor = segments(flat, length)
                if not len(text):
                    continue
                data = flat.data.tobytes()
                digest = xxhash.xxh3_64_intdigest
                prints = np.array([digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(keys[lo + text]),
                     pa.array((start - flat.offsets[text]).astype(np.int32)), pa.array((end - start).astype(np.int32))],
                    names=["anchor", "digest", "text_key", "start", "size"],
                )

    return docs.select("text_key", "text").mapInArrow(scan, "anchor long, digest long, text_key long, start int, size int")


_SPANS = "anchor long, digest long, spans array<struct<a: int, b: int>>"


def _span_batch(rows: list[tuple[int, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    spans = pa.array([[{"a": a, "b": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), spans],
        names=["anchor", "digest", "spans"],
    )


def _bucket_spans(length: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            spans = _covered([h[3] for h in held], [h[2] for h in held], length)
            rows = [(h[0], h[1], s) for h, s in zip(held, spans, strict=True) if s]
            if rows:
                yield _span_batch(rows)

        for table in runs(batches, ["anchor"]):
            seen = set()
            for anchor, digest, n, piece in zip(*(table.column(c).to_pylist() for c in ("anchor", "digest", "n", "piece")), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    held.append((anchor, digest, n, piece))
                    size += len(piece)
            if size >= BATCH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return solve


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``anchor, digest, n, hot, piece``: the bytes of one occurrence of each wanted segment."""
    per_text = wanted.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "digest", "n", "hot", "start", "size")).alias("cuts"))
    joined = docs.select("text_key", "text").join(per_text.hint("shuffle_hash"), "text_key").select("text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for text, cuts in zip(texts, batch.column(1), strict=True):
                data = memoryview(text.as_buffer())
                rows = cuts.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["anchor"] for r in rows]), pa.array([r["digest"] for r in rows]), pa.array([r["n"] for r in rows]),
                     pa.array([r["hot"] for r in rows]),
                     pa.array([bytes(data[r["start"] : r["start"] + r["size"]]) for r in rows], pa.binary())],
                    names=["anchor", "digest", "n", "hot", "piece"],
                )

    return joined.mapInArrow(cut, "anchor long, digest long, n long, hot boolean, piece binary")


def _window_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of the segments of large buckets, by counting their windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, digest, n, piece in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "piece")), strict=True):
                count = len(piece) - length + 1
                prints = [xxhash.xxh3_128_intdigest(piece[i : i + length]) for i in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * count), pa.array([digest] * count), pa.array([n] * count), pa.array(range(count), pa.int32()),
                     pa.array([p & (2**63 - 1) for p in prints]), pa.array([p >> 65 for p in prints])],
                    names=["anchor", "digest", "n", "at", "p", "q"],
                )

    rows = shared_table(pieces.mapInArrow(windows, "anchor long, digest long, n long, at int, p long, q long"))
    twice = rows.groupBy("p", "q").agg(F.sum("n").alias("all")).filter("all > 1").select("p", "q")
    hits = rows.join(twice, ["p", "q"], "left_semi")
    span = F.struct(F.col("at").alias("a"), (F.col("at") + length).cast("int").alias("b"))
    return hits.groupBy("anchor", "digest").agg(F.collect_list(span).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``text_key, spans`` (bytes, end exclusive, not merged) of the texts of ``(text_key, text)`` with repeated strings."""
    rows = shared_table(_segment_rows(docs, length))
    shared = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    met = shared_table(rows.join(shared, "anchor", "left_semi"))
    distinct = met.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "start", "size")).alias("at")
    )
    distinct = shared_table(distinct.select("anchor", "digest", "n", "at.text_key", "at.start", "at.size"))
    buckets = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))
    mixed = distinct.join(buckets.filter("members > 1"), "anchor").withColumn("hot", F.col("bytes") > bucket_bytes)
    pieces = shared_table(_pieces(docs, mixed))
    small = pieces.filter("not hot").repartition("anchor").sortWithinPartitions("anchor")
    partly = small.mapInArrow(_bucket_spans(length), _SPANS).union(_window_spans(pieces.filter("hot"), length).select("anchor", "digest", "spans"))
    all_ = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))
    whole = distinct.filter("n > 1").select("anchor", "digest", all_.alias("spans"))
    spans = whole.union(partly.join(distinct.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_anti"))
    placed = met.join(spans, ["anchor", "digest"]).select(
        "text_key", F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b"))).alias("spans")
    )
    return placed.groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``(doc_id, text)``.

    A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else, in the same document or
    another; strings never cross documents, and are judged on the input. A null text is empty. Repeated rows are copies of
    each other and lose all bytes covered that way. Null ids come out as they went in; an empty table gives no rows;
    other columns are not looked at.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed, length, bucket_bytes)
    joined = keyed.join(spans.hint("shuffle_hash"), "text_key", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs_, shas = [], [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                data = memoryview(text.as_buffer())
                gone = _joined([(s["a"], s["b"]) for s in spans.as_py() or []])
                sha, at = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in gone))
                runs_.append(len(gone))
                shas.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(shas, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
