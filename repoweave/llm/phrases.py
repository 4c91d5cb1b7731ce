"""Collocations per language from a weighted de Bruijn graph of words.

Texts are cut into pieces and words. An edge of the graph is a stretch of ``longest`` words and leads from the node of its
first ``longest - 1`` words to the node of its last; its weight is how often it occurs. A stretch at the end of a piece that
is too short to be an edge is kept as a correction of its own. So every word of the corpus starts exactly one edge or
correction, and only these are counted: what occurs at a node is the flow out of it (all edges that start with its words)
plus the pieces that end there, and the same step from each length to the one below gives the counts of all shorter phrases.
Edges are sent by their first two words and sorted, so that the flow is summed in one pass over the sorted edges. A task gathers
edges and sends them as compressed blocks of numbers; they are laid out as bytes, to be sorted, where they arrive.

A phrase that occurs ``min_count`` times has only words that do. A pass before the count finds those and keeps digests of them
as bits of a fixed number, and the pieces also end at whatever certainly is rarer. Digests that fall together only make the
filter let more through. Edges travel as short codes: the most frequent words, up to a fixed number, have two or three
bytes, any other word is spelled. The same pass finds the pairs that start a fair share of all edges; their edges are dealt
out by the third word, and the sums of the parts are added.

Among the frequent edges, nodes with one way in and one way out of equal weight are compacted: whole paths of them become
one passage. What lies in a passage is said once by it, not by each of its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.llm.words import Flat, flat_slices, mix, released, span_hash
from repoweave.operators.joins import salted_join
from repoweave.operators.numbering import number_rows
from repoweave.session import shared_checkpoint

# Below a power of two, for tables of powers are as long as the next one and stay in the worker.
SLICE_BYTES = (1 << 20) - 2
FILTER_BITS = 25
PATH_EDGES = 64
# A pair that starts more than this share of all words is hot: at most as many pairs as its inverse. Slices report shares half
# as large, so that a pair which is hot somewhere is seen.
HOT_SHARE = 1 / 1000
HOT_PARTS = 64
# Words with a code of their own: the first SHORT_CODES of them in two bytes, the others in three.
MOST_CODES = 1 << 17
SHORT_CODES = 1 << 15
# First byte of codes of three bytes, end of a phrase, and the byte around a spelled word; UTF-8 has no 0xFE and 0xFF.
LONG, STOP, SPELLED = 0x80, 0xFE, 0xFF
# Counts that a task holds before it sends them.
MOST_HELD = 100_000
# Edges that a task gathers before it sends them, and those of a block.
HELD_EDGES = 1 << 19
BLOCK_EDGES = 1 << 16
BLOCK = pa.schema(
    {"at": pa.int32(), "n": pa.int32(), "langs": pa.list_(pa.string()), "spelled": pa.list_(pa.string()), "edges": pa.binary()}
)

_INSIDE = np.ones(256, dtype=bool)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE[[0x20, 0x09, *np.flatnonzero(_BREAK)]] = False
_NEXT = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of a slice of texts: byte spans, digests (of word and language), and the piece of each."""

    def __init__(self, flat: Flat, lang_hash: np.ndarray):
        self.flat = flat
        self.starts, self.ends = flat.runs(_INSIDE[flat.data])
        doc = flat.doc_of(self.starts)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[flat.data])])
        self.doc, self.piece = doc, breaks[self.starts] + doc
        self.hash = mix(span_hash(flat.prefix_hash(), self.starts, self.ends) ^ lang_hash[doc])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word goes on in its piece, and the digest of it with the next word."""
        goes_on = self.piece[:-1] == self.piece[1:]
        return goes_on, mix(self.hash[:-1] * _NEXT + self.hash[1:])

    def cut(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that may be frequent, and whether each goes on to the next one of them."""
        kept = has(words, self.hash)
        return kept, self.pairs()[0] & kept[:-1] & kept[1:]


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    length = ends - starts
    offsets = np.concatenate([[0], np.cumsum(length)])
    taken = data[np.repeat(starts - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken))


def slot(digest: np.ndarray) -> np.ndarray:
    return (digest >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def has(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    at = slot(digest)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words]]:
    """``lang`` and words of slices of ``(lang, lang_hash, text)`` batches."""
    for batch in batches:
        lang_hash = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo, hi, flat in flat_slices(batch.column(2), SLICE_BYTES):
            yield batch.column(0).slice(lo, hi - lo), Words(flat.lower(), lang_hash[lo:hi])


def _bits(frequent: DataFrame) -> np.ndarray:
    """The digests ``h`` as a bit each; ``2 ** (FILTER_BITS - 3)`` bytes, whatever their number."""
    at = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    chunks = frequent.groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in chunks.collect():
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        begin = (row["chunk"] - 1) * len(bits)
        out[begin : begin + len(bits)] = bits
    return out


def _counted(digests: np.ndarray) -> tuple[pa.Array, pa.Array]:
    values, counts = np.unique(digests, return_counts=True)
    return pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))


def _word_counts(texts: DataFrame, min_count: int) -> DataFrame:
    """``lang, word, pair, n``: words per language (``word`` and ``pair`` null), frequent words, and digests of pairs that are
    hot in some slice (``lang`` null)."""
    names = ["lang", "word", "pair", "n"]

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _slices(batches):
            langs = lang.dictionary_encode()
            of_word = langs.indices.to_numpy().astype(np.int64)[found.doc]
            of_lang = np.bincount(of_word, minlength=len(langs.dictionary))
            none, no_pair = pa.nulls(len(of_lang), pa.string()), pa.nulls(len(of_lang), pa.int64())
            yield pa.RecordBatch.from_arrays([langs.dictionary, none, no_pair, pa.array(of_lang)], names=names)
            spelled = strings(found.flat.data, found.starts, found.ends).dictionary_encode()
            size = max(len(spelled.dictionary), 1)
            word, n = np.unique(of_word * size + spelled.indices.to_numpy(), return_counts=True)
            words = spelled.dictionary.take(pa.array(word % size)).cast(pa.string())
            of = langs.dictionary.take(pa.array(word // size))
            yield pa.RecordBatch.from_arrays([of, words, pa.nulls(len(n), pa.int64()), pa.array(n)], names=names)
            goes_on, pair = found.pairs()
            digest, n = _counted(pair[goes_on])
            hot = pc.greater(n, len(found.hash) * HOT_SHARE / 2)
            digest, n = digest.filter(hot), n.filter(hot)
            none = pa.nulls(len(n), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, digest, n], names=names)

    rows = texts.mapInArrow(scan, "lang string, word string, pair long, n long")
    counted = rows.groupBy("lang", "word", "pair").agg(F.sum("n").alias("n"))
    return shared_checkpoint(counted.filter(F.col("word").isNull() | (F.col("n") >= min_count)))


def _word_bits(frequent: DataFrame) -> np.ndarray:
    """The bits of ``(lang, word)``."""

    @released
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_lang = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, flat in flat_slices(batch.column(1), SLICE_BYTES):
                hashes = span_hash(flat.prefix_hash(), flat.offsets[:-1], flat.offsets[1:])
                yield pa.RecordBatch.from_arrays([pa.array(mix(hashes ^ of_lang[lo:hi]).view(np.int64))], names=["h"])

    return _bits(frequent.select(F.xxhash64("lang").alias("lang_hash"), "word").mapInArrow(digest, "h long"))


def _codes(frequent: DataFrame, most: int) -> list[str]:
    """The most frequent words, at most ``most``, by falling count: those above a power of two that leaves few enough."""
    total = frequent.groupBy("word").agg(F.sum("n").alias("n"))
    steps = total.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # at most 64
    lowest, held = 64, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["words"]
        if held > most:
            break
        lowest = row["step"]
    rows = total.filter(F.floor(F.log2("n")) >= lowest).select("word", "n").toArrow().to_pylist()
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def code_of(number: int | None, word: bytes) -> bytes:
    """Codes end themselves: what two codes share at the start never ends inside one of them."""
    if number is None:
        return bytes([SPELLED]) + word + bytes([SPELLED])
    if number < SHORT_CODES:
        return number.to_bytes(2, "big")
    return ((LONG << 16) + number - SHORT_CODES).to_bytes(3, "big")


def split_codes(row: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(row):
        first = row[i]
        j = i + 2 if first < LONG else i + 3 if first != SPELLED else row.index(SPELLED, i + 1) + 1
        out.append(row[i:j])
        i = j
    return out


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """Rows of ``n`` spans of bytes, one from each of ``(data, starts, ends)``, after each other."""
    sizes = [ends - starts for _, starts, ends in parts]
    offsets = np.concatenate([[0], np.cumsum(sum(sizes))])
    out = np.empty(offsets[-1], dtype=np.uint8)
    begin = offsets[:-1].copy()
    for (data, starts, _), size in zip(parts, sizes, strict=True):
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + at] = data[np.repeat(starts, size) + at]
        begin += size
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    return kept.cast(pa.binary())


def _fixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers as four bytes each, highest first."""
    starts = np.arange(len(values), dtype=np.int64) * 4
    return values.astype(">u4").view(np.uint8), starts, starts + 4


def _blocks(texts: DataFrame, words, codes, longest: int, hot: np.ndarray, parts: int) -> DataFrame:
    """``at, n, langs, spelled, edges``: edges (``longest`` words) and the corrections at ends of pieces that a task has gathered,
    counted and sorted, in blocks for each of ``parts`` partitions.

    All with the same first two words go to one partition, or to ``HOT_PARTS`` of them by the third word if the digest of the
    pair is in ``hot``. ``edges`` holds ``n`` numbers each for language, words (0: none), part and count. Words without a code
    are numbered behind those with one, as ``spelled``.
    """

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(codes.value, pa.large_string())
        langs: dict[str, int] = {}
        others: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks() -> pa.RecordBatch:
            rows = list(_sorted_blocks(held, list(langs), list(others), len(known)))
            langs.clear()
            others.clear()
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK.types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=BLOCK)

        for lang, found in _slices(batches):
            kept, goes_on = found.cut(words.value)
            at = np.flatnonzero(kept)
            if not len(at):
                continue
            last = np.append(~goes_on, True)[at]  # the last word of its piece
            end = at[last][np.cumsum(np.append(0, last[:-1]))]  # and the place of that word
            size = np.minimum(end - at + 1, longest)
            spelled = strings(found.flat.data, found.starts[at], found.ends[at]).dictionary_encode()
            code = pc.fill_null(pc.index_in(spelled.dictionary, value_set=known), -1).to_numpy().astype(np.int64)
            absent = np.flatnonzero(code < 0)
            code[absent] = [len(known) + others.setdefault(w, len(others)) for w in spelled.dictionary.take(pa.array(absent)).to_pylist()]
            number = code[spelled.indices.to_numpy()] + 1
            named = lang.dictionary_encode()
            of_lang = np.array([langs.setdefault(v, len(langs)) for v in named.dictionary.to_pylist()], dtype=np.int64)
            edges = np.zeros((longest + 2, len(at)), dtype=np.uint32)
            edges[0] = of_lang[named.indices.to_numpy(zero_copy_only=False)[found.doc[at]]]
            for i in range(longest):
                inside = np.flatnonzero(size > i)
                edges[1 + i, inside] = number[inside + i]
            digest = found.hash[at]
            second, third = (np.where(size > i, np.append(digest[i:], digest[:i]), 0) for i in (1, 2))
            pair = mix(digest * _NEXT + second)
            part = np.where(np.isin(pair, hot), third % np.uint64(HOT_PARTS) + np.uint64(1), 0)
            edges[-1] = part
            held.append((edges, (mix(pair + part) % np.uint64(parts)).astype(np.int32)))
            if sum(len(to) for _, to in held) >= HELD_EDGES:
                yield blocks()
        if held:
            yield blocks()

    return texts.mapInArrow(scan, "at int, n int, langs array<string>, spelled array<string>, edges binary")


def _sorted_blocks(held: list[tuple[np.ndarray, np.ndarray]], langs: list[str], others: list[str], known: int) -> Iterator[tuple]:
    """Rows of ``_blocks`` from columns of edges (language, words, part) and the partition of each; empties ``held``."""
    columns, to = np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held])
    held.clear()
    bits = max(int(columns[:-1].max()).bit_length(), 1)
    several = 64 // bits  # columns that fit one key
    keys = []
    for i in range(0, len(columns) - 1, several):
        key = columns[i].astype(np.uint64)
        for column in columns[i + 1 : min(i + several, len(columns) - 1)]:
            key = key << np.uint64(bits) | column
        keys.append(key)
    order = np.lexsort(keys[::-1])
    first = np.zeros(len(order), dtype=bool)
    first[0] = True
    while keys:
        key = keys.pop()[order]
        first[1:] |= key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(order)))
    order = order[begin]
    dealt = np.argsort(to[order].astype(np.uint16) if to.max() < 1 << 16 else to[order], kind="stable")  # 16 bits: radix sort
    order, count = order[dealt], count[dealt].astype(np.uint32)
    to = to[order]
    starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(to)).tolist(), strict=True):
        for at in range(lo, hi, BLOCK_EDGES):
            its = slice(at, min(at + BLOCK_EDGES, hi))
            block = np.vstack([columns[:, order[its]], count[its]]).astype("<u4", order="C")
            its_langs, block[0] = np.unique(block[0], return_inverse=True)
            is_other = block[1:-2] > known
            its_others, number = np.unique(block[1:-2][is_other], return_inverse=True)
            block[1:-2][is_other] = number + known + 1
            # All first bytes of a column, then all second ones: the higher ones are mostly alike.
            planes = block.view(np.uint8).reshape(*block.shape, 4).transpose(0, 2, 1).tobytes()
            yield (
                int(to[at]), block.shape[1], [langs[i] for i in its_langs.tolist()],
                [others[i - known - 1] for i in its_others.tolist()], pa.compress(planes, codec="zstd", asbytes=True),
            )


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum([0, *map(len, values)])


def _edges(texts: DataFrame, words, codes, longest: int, hot: np.ndarray | None = None) -> DataFrame:
    """``edge``: edges and corrections as bytes: a bucket (4), the language, the codes of the words, the end mark, and the count (4).

    They are sent in blocks, so those with the same first two words, and part of a hot pair, are in one partition and have one
    bucket, an odd number if the pair is in ``hot``. Sorted by bytes, edges with the same first words stand together.
    """
    hot = np.zeros(0, dtype=np.uint64) if hot is None else hot
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @released
    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(codes.value)
        code, code_at = _table([b"", *(code_of(i, b"") for i in range(known))])
        stop = np.full(1, STOP, dtype=np.uint8)
        for batch in batches:
            for _, n, langs, spelled, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                planes = np.frombuffer(pa.decompress(packed, (longest + 3) * 4 * n, codec="zstd"), dtype=np.uint8)
                columns = np.ascontiguousarray(planes.reshape(-1, 4, n).transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)
                of_lang, numbers, part, count = columns[0], columns[1:-2], columns[-2], columns[-1]
                lang, lang_at = _table([code_of(None, v.encode()) for v in langs])
                data, ends = code, code_at
                if spelled:
                    more, more_at = _table([code_of(None, w.encode()) for w in spelled])
                    data, ends = np.concatenate([code, more]), np.concatenate([code_at, code_at[-1] + more_at[1:]])
                first, second = np.where(numbers[:2] > known, 0, numbers[:2]).astype(np.uint64)
                bucket = mix((first << np.uint64(32) | second) * _NEXT + part.astype(np.uint64)) >> np.uint64(33) << np.uint64(1)
                edge = _joined(
                    [
                        _fixed(bucket + (part > 0)), (lang, lang_at[of_lang], lang_at[of_lang + 1]),
                        *[(data, ends[word], ends[word + 1]) for word in numbers],
                        (stop, np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)), _fixed(count),
                    ],
                    n,
                )
                yield pa.RecordBatch.from_arrays([edge], names=["edge"])

    blocks = _blocks(texts, words, codes, longest, hot, parts).repartitionById(parts, F.col("at"))
    return blocks.mapInArrow(lay_out, "edge binary")


def _alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``starts`` to ``ends`` are those of the row before."""
    size = ends - starts
    alike = np.append(False, size[1:] == size[:-1])
    rows = np.flatnonzero(alike & (size > 0))
    if len(rows):
        size = size[rows]
        at = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(at, size)
        equal = data[np.repeat(starts[rows], size) + step] == data[np.repeat(starts[rows - 1], size) + step]
        alike[rows] = np.logical_and.reduceat(equal, at)
    return alike


def _levels(rows: pa.Array, longest: int):
    """Bytes, starts, ends of the language and counts of edges in order; and for the first 1 to ``longest`` words whether an edge
    is the first with these, where they end, and whether it has as many."""
    rows = rows.cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2], dtype=np.uint8)[: offsets[-1]]
    starts, stops = offsets[:-1], offsets[1:] - 5
    counts = sum(data[stops + i].astype(np.int64) << (8 * (4 - i)) for i in range(1, 5))
    marks = np.append(np.flatnonzero(data == SPELLED), len(data))
    begin = marks[np.searchsorted(marks, starts + 5)] + 1
    key_ends, same, levels = begin, _alike(data, starts, begin), []
    for _ in range(longest):
        inside = begin < stops
        first = data[begin]
        spelled = marks[np.minimum(np.searchsorted(marks, begin + 1), len(marks) - 1)] - begin + 1
        end = begin + np.where(inside, np.where(first < LONG, 2, np.where(first != SPELLED, 3, spelled)), 0)
        same = same & inside & np.append(False, inside[:-1]) & _alike(data, begin, end)
        levels.append((inside & ~same, end, inside))
        begin = end
    return data, starts, key_ends, counts, levels


def phrase_parts(edges: DataFrame, codes, longest: int, min_count: int, shortest: int = 1) -> DataFrame:
    """``lang, phrase, size, n`` in parts that ``phrase_counts`` adds up: node flow plus ends of pieces.

    Edges of a bucket come in order, so those with the same first words stand together, and sums over such stretches are the
    counts. Phrases of two or more words are finished where they are and sent if frequent, but the parts of a hot pair are added
    afterwards. Sums of single words are held and sent once per task: as many rows as tasks times words, unless phrases begin
    with ``shortest`` words.
    """

    @released
    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codes.value
        singles: dict[bytes, int] = {}  # language and code
        open_: dict[int, tuple[bytes, int, int]] = {}  # per size, the phrase of the last row: bytes, end of its language, sum so far
        out: list[tuple[str, str, int, int]] = []

        def spell(code: bytes) -> str:
            if code[0] == SPELLED:
                return code[1:-1].decode()
            return known[int.from_bytes(code, "big") - (0 if len(code) == 2 else (LONG << 16) - SHORT_CODES)]

        def close(size: int, row: bytes, key_end: int, n: int) -> None:
            if size == 1:
                singles[row[4:]] = singles.get(row[4:], 0) + n
            elif n >= min_count or (size == 2 and row[3] & 1):
                out.append((row[5 : key_end - 1].decode(), " ".join(map(spell, split_codes(row[key_end:]))), size, n))

        def batch_of() -> pa.RecordBatch:
            for key, n in singles.items():
                key_end = key.index(SPELLED, 1) + 1
                out.append((key[1 : key_end - 1].decode(), spell(key[key_end:]), 1, n))
            singles.clear()
            columns = zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["lang", "phrase", "size", "n"])
            out.clear()
            return made

        for batch in batches:
            if not len(batch):
                continue
            data, starts, key_ends, counts, levels = _levels(batch.column(0), longest)
            raw = data.tobytes()
            for size, (begins, ends, inside) in enumerate(levels, 1):
                if size < shortest:
                    continue
                first = np.flatnonzero(begins)
                if not len(first):
                    break
                total = np.add.reduceat(np.where(inside, counts, 0), first)
                kept = np.arange(len(first)) if size == 1 else np.flatnonzero((total >= min_count) | ((data[starts[first] + 3] & 1 == 1) & (size == 2)))
                spans = [raw[starts[i] : ends[i]] for i in (first[0], first[-1])]
                if size in open_:
                    row, key_end, n = open_.pop(size)
                    if row == spans[0]:
                        total[0] += n
                        kept = np.union1d(kept, [0])
                    else:
                        close(size, row, key_end, n)
                last = len(first) - 1
                for j in kept[kept < last].tolist():
                    i = first[j]
                    close(size, raw[starts[i] : ends[i]], int(key_ends[i] - starts[i]), int(total[j]))
                i = first[last]
                open_[size] = spans[1], int(key_ends[i] - starts[i]), int(total[last])
            if len(out) + len(singles) >= MOST_HELD:
                yield batch_of()
        for size, (row, key_end, n) in open_.items():
            close(size, row, key_end, n)
        if out or singles:
            yield batch_of()

    return edges.sortWithinPartitions("edge").mapInArrow(flow, "lang string, phrase string, size int, n long")


def phrase_counts(edges: DataFrame, codes, longest: int, min_count: int, shortest: int = 1) -> DataFrame:
    """``lang, phrase, size, n`` of all frequent phrases of ``shortest`` to ``longest`` words."""
    rows = phrase_parts(edges, codes, longest, min_count, shortest)
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def first_words(phrase: str, k: Column | int) -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), k if isinstance(k, Column) else F.lit(k))


def last_words(phrase: str, k: Column | int) -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), -k if isinstance(k, Column) else F.lit(-k))


def unary_paths(edges: DataFrame, longest: int) -> DataFrame:
    """Passages ``lang, passage, n`` that hold every edge ``(lang, phrase, n)`` exactly once: paths through nodes with one
    edge in and one out, both of weight ``n``, in parts of at most ``PATH_EDGES`` edges. An edge on a circle of such nodes is
    a passage of its own.

    Each edge looks up the one before it, then the one that this one had found, and so on: the distance doubles with every
    round, so there are as many rounds as the longest path has binary digits.
    """
    one = [F.count(F.lit(1)).alias("ways"), F.min("phrase").alias("edge"), F.min("n").alias("n")]
    into = edges.groupBy("lang", last_words("phrase", longest - 1).alias("node")).agg(*one).filter("ways = 1")
    out = edges.groupBy("lang", first_words("phrase", longest - 1).alias("node")).agg(*one).filter("ways = 1")
    links = into.alias("i").join(out.alias("o"), ["lang", "node"]).filter("i.n = o.n and i.edge <> o.edge")
    links, seen = shared_checkpoint(
        links.select("lang", F.col("o.edge").alias("phrase"), F.col("i.edge").alias("up"), F.lit(1).cast("long").alias("steps")),
        left=F.count(F.lit(1)),
    )
    left = seen["left"]
    while left:
        above = links.select("lang", F.col("phrase").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        links, seen = shared_checkpoint(
            links.join(above, ["lang", "up"], "left").select(
                "lang", "phrase", F.coalesce("_up", "up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                F.col("_up").isNotNull().alias("open"),
            ),
            left=F.count_if("open"),
        )
        # The last rounds of a path leave fewer and fewer open; those of a circle stay open for ever.
        if seen["left"] == left:
            links = links.filter("not open")
            break
        left = seen["left"]
    placed = edges.join(links.select("lang", "phrase", "up", "steps"), ["lang", "phrase"], "left")
    head, steps = F.coalesce("up", "phrase"), F.coalesce("steps", F.lit(0))
    parts = placed.groupBy("lang", head.alias("head"), F.floor(steps / PATH_EDGES).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(steps.alias("steps"), "phrase"))).alias("edges"), F.min("n").alias("n")
    )
    more = F.transform(F.slice("edges", F.lit(2), F.size("edges")), lambda e: F.substring_index(e["phrase"], " ", -1))
    passage = F.array_join(F.concat(F.array(F.col("edges")[0]["phrase"]), more), " ")
    return parts.select("lang", passage.alias("passage"), "n")


def _inside(passages: DataFrame, longest: int) -> DataFrame:
    """``lang, phrase, n`` of all stretches of 2 to ``longest`` words in ``passages (lang, passage, n)``."""
    words = F.split("passage", " ")
    cut = passages.select("lang", "n", words.alias("words")).filter(F.size("words") >= 2)
    starts = cut.select("lang", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("at"))
    size = F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.size("words") - F.col("at") + 1)))
    spans = starts.select("lang", "n", "words", "at", size.alias("size"))
    return spans.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "n")


def score(wide: dict[str, Column]) -> Column:
    """``floor(1000 * a * n / (l * r))`` of decimals, exact."""
    return F.call_function("div", F.lit(1000).cast("decimal(38,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])


def collocations(docs: DataFrame, longest: int = 5, min_count: int = 100, percent: int = 100, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``.

    Reads ``(lang, text)``, with A-Z in lower case. A phrase of 2 to ``longest`` words that occurs ``a >= min_count`` times is
    cut in two where ``floor(1000 * a * n / (l * r))`` is lowest (the first such cut), ``l`` and ``r`` being how often its
    parts occur and ``n`` all words of the language. Phrases inside a longer candidate with
    ``100 * f(longer) >= percent * a`` are left out. Order: score and ``a`` descending, then the bytes of the phrase. A null
    language is ``und``; null, empty and blank texts hold nothing; a repeated row counts again; an empty table gives no rows.
    Other columns are not looked at. Products are decimals of 38 digits.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.coalesce("text", F.lit("")).alias("text"))
    counted = _word_counts(texts, min_count)
    totals = counted.filter("word is null and pair is null").select("lang", "n")
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    frequent = counted.filter("word is not null").select("lang", "word", "n")
    words = spark.sparkContext.broadcast(_word_bits(frequent))
    codes = spark.sparkContext.broadcast(_codes(frequent, MOST_CODES))
    hot = counted.filter(F.col("pair").isNotNull() & (F.col("n") > all_words * HOT_SHARE))  # at most 1 / HOT_SHARE
    hot = np.array([r["pair"] for r in hot.select("pair").collect()], dtype=np.int64).view(np.uint64)
    # Single words are counted already, and only those of two or more are left to the flow.
    counts = phrase_counts(_edges(texts, words, codes, longest, hot), codes, longest, min_count, shortest=2)
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    every = shared_checkpoint(counts.unionByName(single))

    inside = None
    for size in range(3, longest + 1):
        of_size = every.filter(F.col("size") == size).select("lang", "phrase", "n")
        of_size = unary_paths(of_size, longest) if size == longest else of_size.withColumnRenamed("phrase", "passage")
        spans = _inside(of_size, size - 1)
        inside = spans if inside is None else inside.union(spans)
    candidates = every.filter("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size")
    if inside is not None:
        longer = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        within = F.coalesce(F.col("longer") * 100 >= F.col("a") * percent, F.lit(False))
        candidates = candidates.join(longer, ["lang", "phrase"], "left").filter(~within).drop("longer")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        first_words("phrase", F.col("k")).alias("left"), last_words("phrase", F.col("size") - F.col("k")).alias("right"),
    )
    cuts = shared_checkpoint(cuts)
    for side, count in (("left", "l"), ("right", "r")):
        parts = every.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        cuts = salted_join(cuts, parts, ["lang", side], ["phrase"])
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    cuts = salted_join(cuts, totals, ["lang"], ["phrase"])
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score(wide).alias("score"), "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    ranked = number_rows(best, ["-score", "-a", "phrase"], ["lang"], "rank").filter(F.col("rank") < most)
    return ranked.select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
