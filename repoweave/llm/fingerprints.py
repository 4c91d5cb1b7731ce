"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, or a stretch of one: a line is cut after each word whose digest says so, one in four on average, so
that long lines change in one place only. A text is the set of its paragraphs, the second of two equal ones counting as
another. Each has a digest and a weight (its bytes) and is added to one cell in each of three parts of a sketch; a cell sums
counts, digests, check values and weights. The difference of two sketches is the sketch of the paragraphs that differ: a cell
that holds one of them shows its digest, which is taken out of its other cells, and so on until all are recovered. When that
stops early the sketches were too small, and larger ones are compared. The fingerprint is the smallest sketch, which equal
texts share. Likeness is the weight of what is in both texts over the weight of what is in either.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.llm.words import Flat, flat_slices, mix, released, span_hash

PARTS = 3
PART_CELLS = 5
CUT_EVERY = np.uint64(4)
# Text bytes taken at a time, of which a step has some twenty times as much in arrays.
SLICE_BYTES = 1 << 19
_SEEDS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
_CHECK = np.uint64(0x082EFA98EC4E6C89)
_AGAIN = np.uint64(0x452821E638D01377)


class Paragraphs:
    """Paragraphs of the texts of a slice: ``owner`` (the text, ascending), ``digest`` and ``weight`` of each."""

    def __init__(self, owner: np.ndarray, digest: np.ndarray, weight: np.ndarray, n: int):
        self.owner, self.digest, self.weight, self.n = owner, digest, weight, n
        self.count = np.bincount(owner, minlength=n)
        self.total = np.bincount(owner, weights=weight, minlength=n).astype(np.int64)

    @staticmethod
    def of(flat: Flat) -> Paragraphs:
        starts, ends = flat.words()
        prefix = flat.prefix_hash()
        line = np.concatenate([[0], np.cumsum(flat.data == 0x0A)])[starts]
        doc = flat.doc_of(starts)
        last = span_hash(prefix, starts, ends) % CUT_EVERY == 0
        last[:-1] |= (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        if len(last):
            last[-1] = True
        first = np.append(True, last[:-1])[: len(last)]
        starts, ends, owner = starts[first], ends[last], doc[first]
        digest = span_hash(prefix, starts, ends)
        # The second of equal paragraphs of a text gets another digest than the first.
        order = np.lexsort((digest, owner))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (digest[order][1:] != digest[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        place = np.arange(len(order))
        before = np.empty(len(order), dtype=np.int64)
        before[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        digest = np.where(before > 0, mix(digest + before.astype(np.uint64) * _AGAIN), digest)
        return Paragraphs(owner, digest, ends - starts, flat.n)

    def only(self, owners: np.ndarray) -> Paragraphs:
        """Of some texts, numbered anew."""
        number = np.full(self.n, -1)
        number[owners] = np.arange(len(owners))
        kept = number[self.owner] >= 0
        return Paragraphs(number[self.owner[kept]], self.digest[kept], self.weight[kept], len(owners))


class Sketch:
    """Cells of ``n`` texts, ``PARTS * size`` each. All sums are modulo a power of two."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        cells = n * PARTS * size
        self.count = np.zeros(cells, dtype=np.int32)
        self.digest = np.zeros(cells, dtype=np.uint64)
        self.check = np.zeros(cells, dtype=np.uint32)
        self.weight = np.zeros(cells, dtype=np.uint32)

    def cells(self, owner: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """The cells of each paragraph, part by part."""
        base = owner * (PARTS * self.size)
        parts = [base + i * self.size + (mix(digest ^ s) % np.uint64(self.size)).astype(np.int64) for i, s in enumerate(_SEEDS)]
        return np.concatenate(parts)

    def add(self, owner: np.ndarray, digest: np.ndarray, weight: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = self.cells(owner, digest)
        sign = np.broadcast_to(np.asarray(sign, dtype=np.int64), owner.shape)
        np.add.at(self.count, at, np.tile(sign.astype(np.int32), PARTS))
        np.add.at(self.digest, at, np.tile(digest * sign.view(np.uint64), PARTS))
        np.add.at(self.check, at, np.tile(check_value(digest) * sign.astype(np.uint32), PARTS))
        np.add.at(self.weight, at, np.tile((weight * sign).astype(np.uint32), PARTS))

    @staticmethod
    def of(paragraphs: Paragraphs, size: int = PART_CELLS) -> Sketch:
        out = Sketch(paragraphs.n, size)
        out.add(paragraphs.owner, paragraphs.digest, paragraphs.weight)
        return out

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(self.n, self.size)
        for field in ("count", "digest", "check", "weight"):
            setattr(out, field, getattr(self, field) - getattr(other, field))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the cells as far as they go: ``owner, digest, weight, sign`` of what came out, and texts that are done."""
        found = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at].astype(np.int64)
            digest = self.digest[at] * sign.view(np.uint64)
            seed = np.array(_SEEDS)[at // self.size % PARTS]
            pure = check_value(digest) == self.check[at] * sign.astype(np.uint32)
            pure &= mix(digest ^ seed) % np.uint64(self.size) == (at % self.size).astype(np.uint64)
            at, sign, digest = at[pure], sign[pure], digest[pure]
            if not len(at):
                break
            owner = at // (PARTS * self.size)
            weight = (self.weight[at] * sign.astype(np.uint32)).astype(np.int64)
            order = np.lexsort((digest, owner))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (digest[order][1:] != digest[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            one = order[new]
            found.append((owner[one], digest[one], weight[one], sign[one]))
            self.add(owner[one], digest[one], weight[one], -sign[one])
        rest = (self.count != 0) | (self.digest != 0)
        done = ~rest.reshape(self.n, -1).any(axis=1)
        columns = zip(*found, strict=True) if found else [[np.zeros(0, dtype=t)] for t in (np.int64, np.uint64, np.int64, np.int64)]
        return *(np.concatenate(c) for c in columns), done

    def strings(self, paragraphs: Paragraphs) -> list[str]:
        """Number and weight of the paragraphs and the cells of each text, as base64."""
        kind = [("count", "<i4"), ("digest", "<u8"), ("check", "<u4"), ("weight", "<u4")]
        cells = np.zeros(len(self.count), dtype=kind)
        for field, _ in kind:
            cells[field] = getattr(self, field)
        rows = cells.reshape(self.n, -1)
        head = np.stack([paragraphs.count.astype("<i8"), paragraphs.total.astype("<i8")], axis=1)
        return [base64.b64encode(h.tobytes() + r.tobytes()).decode() for h, r in zip(head, rows, strict=True)]


def check_value(digest: np.ndarray) -> np.ndarray:
    return mix(digest ^ _CHECK).astype(np.uint32)


def differences(left: Paragraphs, right: Paragraphs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``pair, digest, weight, sign`` of the paragraphs in one text of a pair only (``sign`` 1: the left one).

    Sketches start small. Where they do not come out empty, the next ones are at least twice as large, or as large as the
    share of empty cells says that they have to be.
    """
    wanted = np.full(left.n, PART_CELLS)
    open_pairs = np.arange(left.n)
    found = []
    while len(open_pairs):
        size = int(wanted[open_pairs].min())
        now = open_pairs[wanted[open_pairs] == size]
        difference = Sketch.of(left.only(now), size).minus(Sketch.of(right.only(now), size))
        empty = (difference.count == 0) & (difference.digest == 0)
        empty = empty.reshape(len(now), -1).mean(axis=1)
        owner, digest, weight, sign, done = difference.peel()
        out = done[owner]
        found.append((now[owner[out]], digest[out], weight[out], sign[out]))
        # With d paragraphs about exp(-d / size) of the cells stay empty; d * 0.7 cells a part are enough as a rule.
        with np.errstate(divide="ignore"):
            guess = np.clip(-np.log(empty) * size * 0.7, 2 * size, 4 * size)
        wanted[now] = PART_CELLS << np.ceil(np.log2(guess / PART_CELLS)).astype(int)
        open_pairs = np.setdiff1d(open_pairs, now[done], assume_unique=True)
    columns = list(zip(*found, strict=True)) or [[np.zeros(0, dtype=t)] for t in (np.int64, np.uint64, np.int64, np.int64)]
    return tuple(np.concatenate(c) for c in columns)


def likeness(left: Paragraphs, right: Paragraphs, pair: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shared weight over all weight, from 0 to 1; two texts without paragraphs are alike."""
    apart = np.bincount(pair, weights=weight, minlength=left.n)
    both = (left.total + right.total).astype(np.float64)
    return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1.0), 1.0)


def row_slices(texts: list[pa.Array], limit: int) -> Iterator[tuple[int, int]]:
    """``first row, end row`` of slices of rows whose ``texts`` have at most ``limit`` bytes together, or of one row."""
    sizes = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def whole(texts: pa.Array, lo: int, hi: int) -> Flat:
    """The texts of rows ``lo`` to ``hi``, of which there is one at least, in one piece."""
    return next(flat_slices(texts.slice(lo, hi - lo), 1 << 62))[2]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, fingerprint`` of every row of ``(doc_id, text)``. Null, empty and blank texts have no paragraphs;
    equal texts have equal fingerprints. No shuffle."""

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, flat in flat_slices(batch.column(1), SLICE_BYTES):
                paragraphs = Paragraphs.of(flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(paragraphs.count.astype(np.int64)), pa.array(Sketch.of(paragraphs).strings(paragraphs))],
                    names=["doc_id", "n_paragraphs", "fingerprint"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, n_paragraphs long, fingerprint string")


def compare(versions: DataFrame, text: str, others: list[str], keep: list[str], digests: bool = False) -> DataFrame:
    """Compare the ``text`` of each row with the texts in ``others``.

    Returns the columns ``keep``, ``fingerprint``, and for each other column ``<other>_fingerprint`` and ``<other>_likeness``;
    with ``digests`` also ``<other>_removed`` and ``<other>_added``, the digests of paragraphs only in ``text`` and only in the
    other one, ascending. A null text is an empty one; two texts without paragraphs have likeness 1. Every row is by itself.
    """
    fields = {f.name: f.dataType.simpleString() for f in versions.schema.fields}
    schema = [f"`{c}` {fields[c]}" for c in keep] + ["fingerprint string"]
    for other in others:
        schema += [f"`{other}_fingerprint` string", f"`{other}_likeness` double"]
        if digests:
            schema += [f"`{other}_removed` array<long>", f"`{other}_added` array<long>"]
    names = [s.split("`")[1] if "`" in s else "fingerprint" for s in schema]
    width = len(keep)

    def lists(n: int, pair: np.ndarray, digest: np.ndarray) -> pa.Array:
        order = np.lexsort((digest.view(np.int64), pair))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=n))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(digest.view(np.int64)[order]))

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_slices([batch.column(width + i) for i in range(1 + len(others))], SLICE_BYTES):
                left = Paragraphs.of(whole(batch.column(width), lo, hi))
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(width)]
                columns.append(pa.array(Sketch.of(left).strings(left), pa.string()))
                for i in range(len(others)):
                    right = Paragraphs.of(whole(batch.column(width + 1 + i), lo, hi))
                    pair, digest, weight, sign = differences(left, right)
                    columns.append(pa.array(Sketch.of(right).strings(right), pa.string()))
                    columns.append(pa.array(likeness(left, right, pair, weight)))
                    if digests:
                        columns += [lists(hi - lo, pair[sign == s], digest[sign == s]) for s in (1, -1)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return versions.select(*keep, text, *others).mapInArrow(scan, ", ".join(schema))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text, times``: each different row of ``(doc_id, text)`` with the text of the next one by ascending
    ``doc_id`` (null first, equal ids by a digest of the text), the last one with that of the first, and how often it occurs.
    A null text counts as an empty one. A single row is followed by itself; an empty table gives no rows.

    Rows are dealt into slices of the order by the first key of each, which are at most as many as shuffle partitions, and
    the first row of a slice also goes to the slice before. Equal rows of a batch are sent once, with their number, so a row
    that is repeated very often does not fill a slice.
    """
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    sliced = keyed.select("doc_id", "tie").distinct().repartitionByRange(slices, F.col("doc_id").asc_nulls_first(), "tie")
    firsts = sliced.groupBy(F.spark_partition_id().alias("slice")).agg(F.min(key).alias("key")).collect()
    order = sorted(_key(r["key"]["doc_id"], r["key"]["tie"]) for r in firsts)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @released
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: dict[tuple, int] = {}
            rows, slice_of, times, ahead = [], [], [], []
            for i, (doc_id, tie) in enumerate(zip(ids, ties, strict=True)):
                k = _key(doc_id, tie)
                j = seen.get(k)
                if j is not None and batch.column(2)[rows[j]].equals(batch.column(2)[i]):
                    times[j] += 1
                    continue
                seen[k] = len(rows)
                at = max(bisect_right(order, k) - 1, 0)
                rows.append(i), slice_of.append(at), times.append(1), ahead.append(False)
                if order[at] == k:
                    rows.append(i), slice_of.append((at - 1) % len(order)), times.append(0), ahead.append(True)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slice_of, pa.int32()), pa.array(ahead, pa.bool_()), pa.array(times, pa.int64()), *taken.columns],
                names=["slice", "ahead", "times", "doc_id", "tie", "text"],
            )

    def pack(out: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        kinds = [id_kind, pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
            names=["doc_id", "text", "next_text", "times"],
        )

    @released
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # slice, doc_id, text, times of the row that needs the next one
        for batch in batches:
            out: list[tuple] = []
            held = 0
            columns = [batch.column(i) for i in (0, 1, 2, 3)]
            for i, (at, ahead, times, doc_id) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                if ahead and (waiting is None or waiting[0] != at):
                    continue
                row_text = batch.column(5)[i].as_py()
                if not ahead and waiting is not None and waiting[1:3] == [doc_id, row_text]:
                    waiting[3] += times
                    continue
                if waiting is not None:
                    out.append((waiting[1], waiting[2], row_text, waiting[3]))
                    held += len(waiting[2]) + len(row_text)
                    # A batch holds each text twice; it is sent on in pieces.
                    if held >= SLICE_BYTES:
                        yield pack(out, batch.schema.field(3).type)
                        out, held = [], 0
                waiting = None if ahead else [at, doc_id, row_text, times]
            if out:
                yield pack(out, batch.schema.field(3).type)

    dealt = keyed.mapInArrow(deal, f"slice int, ahead boolean, times long, doc_id {id_type}, tie long, text string")
    placed = dealt.repartitionById(slices, F.col("slice")).sortWithinPartitions(
        "slice", "ahead", F.col("doc_id").asc_nulls_first(), "tie", "text"
    )
    return placed.mapInArrow(follow, f"doc_id {id_type}, text string, next_text string, times long")


def _key(doc_id, tie: int) -> tuple:
    return (doc_id is not None, 0 if doc_id is None else doc_id, tie)


def edited_versions(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, text, edited, next_text, times``: the last quarter of the code points of each text is replaced by the
    first as many (or all) of the next one's."""
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    return with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text", "times")


def near_versions(docs: DataFrame) -> DataFrame:
    """Every row of ``(doc_id, text)`` against an edited version and against the next document: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts are empty; equal rows give equal
    rows; an empty table gives no rows; other columns are not looked at."""
    versions = edited_versions(docs).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keep = ["doc_id", "n_chars", "edited_sha256", "times"]
    found = compare(versions, "text", ["edited", "next_text"], keep)
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.col("edited_likeness").alias("near_edited"), F.col("next_text_likeness").alias("near_next"),
    )
