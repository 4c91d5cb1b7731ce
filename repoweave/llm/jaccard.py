"""Exact joins of documents on the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Shingles have one global order: rarest first by a hashed frequency sketch of fixed size, then by hash. Two sets that are
similar enough share a shingle among the first ``n - ceil(t * n) + 1`` of each, and at least ``l`` among ``l - 1`` more.
Each document chooses its own ``l`` by the number of candidates that the sketch foretells; a pair has to meet the smaller
of its two before it is verified.

Documents of equal sets are one class. Classes that share a prefix shingle form a group. A group of at most ``SMALL``
classes gives its pairs, which are counted over all groups; those with enough matches are candidates. A larger group gives
none: all its members are candidates of each other, and meet. Candidates are tied into clusters. A cluster of at most
``block`` shingles meets as a whole, so each of its sets is sent once; in a larger one, pairs meet by themselves, and
large groups in blocks, every two blocks in a task of their own. In a meeting, overlaps are counted over inverted lists and
only the links of a spanning forest leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoweave.llm.components import components
from repoweave.llm.runs import runs
from repoweave.llm.words import Flat, flat_slices, grams, mix, span_hash
from repoweave.session import shared_table

# A million counts, 4 MB as they are broadcast.
SKETCH_BITS = 20
SKETCH_CHUNK = 4096
MOST_MATCHES = 6
SMALL = 128
PAIRS_AT_ONCE = 1 << 18
BLOCK = 1 << 21


def shingle_sets(flat: Flat, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice as ``(text, hash)``, by text, then hash. A text with fewer words than a
    shingle has one shingle, its whole sequence; a text without words has none."""
    low = flat.lower()
    starts, ends = low.words()
    doc = low.doc_of(starts)
    hashes = span_hash(low.prefix_hash(), starts, ends)
    counts = np.bincount(doc, minlength=flat.n)
    of_window, window = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if len(hashes) >= words:
        at = np.flatnonzero(doc[: len(doc) - words + 1] == doc[words - 1 :])
        of_window, window = doc[at], grams(hashes, words)[at]
    short = np.flatnonzero((counts > 0) & (counts < words))
    first = np.searchsorted(doc, short)
    whole = [grams(hashes[a : a + counts[d]], int(counts[d]))[0] for d, a in zip(short, first, strict=True)]
    all_doc = np.concatenate([of_window, short])
    all_hash = np.concatenate([window, np.array(whole, dtype=np.uint64)])
    order = np.lexsort((all_hash, all_doc))
    all_doc, all_hash = all_doc[order], all_hash[order]
    fresh = np.ones(len(all_doc), dtype=bool)
    fresh[1:] = (all_doc[1:] != all_doc[:-1]) | (all_hash[1:] != all_hash[:-1])
    return all_doc[fresh], all_hash[fresh]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _ordered(doc: np.ndarray, hashes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, sketch[_bucket(hashes)], doc))
    return doc[order], hashes[order]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def matches_wanted(tokens: np.ndarray, n: int, percent: int, sketch: np.ndarray) -> int:
    """The number of shared prefix shingles to ask for, at the least estimated cost.

    ``tokens`` is a set in global order. A prefix for ``l`` matches reads the lists of its shingles, whose lengths the
    sketch estimates above the mean load of a bucket, and leaves at most ``sum of lengths / l`` candidates to verify.
    """
    first = int(prefix_length(np.array([n]), percent)[0])
    most = min(MOST_MATCHES, n - first + 1)
    lists = np.cumsum(np.maximum(sketch[_bucket(tokens[: first + most - 1])] - sketch.mean(), 0.0) + 1e-9)
    wanted = np.arange(1, most + 1)
    total = lists[first - 1 + wanted - 1]
    return int(wanted[np.argmin(total * (1.0 + (n / 8.0) / wanted))])


def _sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Number of (document, shingle) pairs by hash bucket, over all documents. A task sends its counts in chunks, which
    are summed by chunk; the sum has ``2 ** SKETCH_BITS`` counts whatever the input."""
    size = 1 << SKETCH_BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, _, flat in flat_slices(batch.column(0)):
                np.add.at(total, _bucket(shingle_sets(flat, words)[1]), 1)
        if total.any():
            chunks = total.reshape(-1, SKETCH_CHUNK)
            used = np.flatnonzero(chunks.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array([chunks[i].tobytes() for i in used], pa.binary())], names=["chunk", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["chunk"]):
            total = sum(np.frombuffer(c.as_buffer(), dtype=np.int64) for c in table.column("counts"))
            yield pa.RecordBatch.from_arrays(
                [table.column("chunk").slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())],
                names=["chunk", "counts"],
            )

    schema = "chunk long, counts binary"
    parts = docs.select("text").mapInArrow(scan, schema).repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros((size // SKETCH_CHUNK, SKETCH_CHUNK))
    for row in parts.mapInArrow(add, schema).collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return out.ravel().astype(np.float32)


def _sets(docs: DataFrame, words: int, percent: int, sketch) -> DataFrame:
    """``doc_id, text_hash, n, class, wanted, prefix`` of every document; ``wanted`` is its ``l``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sketch.value
        for batch in batches:
            for lo, hi, flat in flat_slices(batch.column(2)):
                doc, hashes = shingle_sets(flat, words)
                n = np.bincount(doc, minlength=flat.n)
                one, two = np.zeros(flat.n, dtype=np.uint64), np.zeros(flat.n, dtype=np.uint64)
                np.add.at(one, doc, mix(hashes))
                np.add.at(two, doc, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                classes = mix(mix(one) ^ (two * np.uint64(3)) ^ n.astype(np.uint64)).view(np.int64)
                doc, hashes = _ordered(doc, hashes, order)
                first = np.searchsorted(doc, np.arange(flat.n))
                ends = np.append(first[1:], len(doc))
                wanted = np.array(
                    [matches_wanted(hashes[a:b], b - a, percent, order) if b > a else 0 for a, b in zip(first, ends, strict=True)],
                    dtype=np.int32,
                )
                length = np.where(n > 0, prefix_length(n, percent) + wanted - 1, 0)
                inside = np.arange(len(doc)) - first[doc] < length[doc]
                borders = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(borders), pa.array(hashes[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(n.astype(np.int64)), pa.array(classes), pa.array(wanted), prefix],
                    names=["doc_id", "text_hash", "n", "class", "wanted", "prefix"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        scan, f"doc_id {id_type}, text_hash long, n long, class long, wanted int, prefix array<long>"
    )


def _group_pairs(percent: int):
    """A task that turns small groups, sorted by token, into pairs ``a, b, wanted`` of classes that may still link.
    Groups of equal size are taken together."""
    names = ["token", "class", "n", "wanted", "level"]

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, cls, n, wanted, level = columns
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        for size in np.unique(sizes[sizes > 1]):
            here = starts[sizes == size]
            one, two = np.triu_indices(int(size), 1)
            for lo in range(0, len(here), max(1, PAIRS_AT_ONCE // len(one))):
                base = here[lo : lo + max(1, PAIRS_AT_ONCE // len(one))]
                i, j = (base[:, None] + one).ravel(), (base[:, None] + two).ravel()
                ask = np.minimum(wanted[i], wanted[j])
                fits = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.maximum(level[i], level[j]) <= ask)
                i, j, ask = i[fits], j[fits], ask[fits]
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j])), pa.array(ask)],
                        names=["a", "b", "wanted"],
                    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                columns = [np.concatenate(p) for p in zip(held, columns, strict=True)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last:
                yield from found([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None:
            yield from found(held)

    return pairs


def _meetings(classes: DataFrame, percent: int, most: int) -> DataFrame:
    """Which classes of ``(class, n, wanted, prefix)`` have to meet: ``class, group, part``, ``part`` telling the two blocks
    of a large group apart."""
    first = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100).cast("long") + 1
    rows = classes.select("class", "n", "wanted", F.posexplode("prefix").alias("pos", "token")).select(
        "class", "token", "n", "wanted", F.greatest(F.col("pos") - first + 2, F.lit(1)).cast("int").alias("level")
    )
    same = Window.partitionBy("token")
    met = shared_table(
        rows.withColumn("size", F.count(F.lit(1)).over(same)).filter("size > 1").sortWithinPartitions("token")
    )
    # Groups that fit are paired where they lie; the files keep each group together and in order.
    small = met.filter(F.col("size") <= SMALL).repartition("token").sortWithinPartitions("token")
    counted = small.mapInArrow(_group_pairs(percent), "a long, b long, wanted int").groupBy("a", "b")
    pairs = shared_table(counted.agg(F.count(F.lit(1)).alias("got"), F.max("wanted").alias("wanted")).filter("got >= wanted"))
    hot = met.filter(F.col("size") > SMALL).groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("class").alias("lead"),
        F.expr("bit_xor(xxhash64(class))").alias("members"),
    )
    # Groups of the same members are one.
    chosen = hot.groupBy("size", "members").agg(F.min(F.struct("token", "weight", "lead")).alias("t")).select("t.*")
    joined = met.filter(F.col("size") > SMALL).select("class", "token").join(chosen, "token")
    ties = joined.select(F.col("class").alias("a"), F.col("lead").alias("b")).union(pairs.select("a", "b"))
    cluster = components(ties).withColumnRenamed("node", "class")
    sized = cluster.join(classes.select("class", "n"), "class")
    weights = sized.groupBy("component").agg(F.sum("n").alias("all"))
    placed = shared_table(sized.join(weights, "component").select("class", "component", "all"))
    whole = placed.filter(F.col("all") <= most).select(
        "class", F.col("component").alias("group"), F.lit(-1).cast("long").alias("part")
    )
    large = placed.filter(F.col("all") > most).select("class")
    blocks = F.ceil(F.col("weight") / F.lit(float(most))).cast("int")
    mine = F.pmod(F.xxhash64("class", F.lit(5)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    in_blocks = joined.join(large, "class", "left_semi").select(
        "class", F.col("token").alias("group"), mine.alias("mine"), blocks.alias("blocks"), other
    )
    part = F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")
    alone = pairs.join(large, pairs["a"] == large["class"], "left_semi")
    two = alone.select(F.explode(F.array("a", "b")).alias("class"), F.xxhash64("a", "b").alias("group"), F.lit(-2).cast("long").alias("part"))
    return whole.union(in_blocks.select("class", "group", part.alias("part"))).union(two)


class Meeting:
    """Classes of one group or pair of blocks: sets in global order, one after the other."""

    def __init__(self, classes: np.ndarray, starts: np.ndarray, tokens: np.ndarray, wanted: np.ndarray):
        self.classes, self.starts, self.tokens, self.wanted = classes, starts, tokens, wanted
        self.n = np.diff(starts)

    def links(self, percent: int) -> list[tuple[int, int]]:
        """Links of a spanning forest of the pairs that are similar enough."""
        k = len(self.classes)
        owner = np.repeat(np.arange(k), self.n)
        place = np.arange(len(self.tokens)) - self.starts[owner]
        level = np.maximum(place - (prefix_length(self.n, percent) - 1)[owner] + 1, 1)
        _, code = np.unique(self.tokens, return_inverse=True)
        by_code = np.argsort(code, kind="stable")
        list_starts = np.searchsorted(code[by_code], np.arange(code.max() + 2))
        root = np.arange(k)
        out = []
        for i in range(1, k):
            open_pairs = (root[:i] != root[i]) & (100 * np.minimum(self.n[:i], self.n[i]) >= percent * np.maximum(self.n[:i], self.n[i]))
            if not open_pairs.any():
                continue
            own = slice(self.starts[i], self.starts[i + 1])
            ask = np.minimum(self.wanted[:i], self.wanted[i])
            head = level[own] <= self.wanted[i]
            got = self._lists(by_code, list_starts, code[own][head])
            mine = np.repeat(level[own][head], list_starts[code[own][head] + 1] - list_starts[code[own][head]])
            early = owner[got] < i
            got, mine = got[early], mine[early]
            whose = owner[got]
            fits = np.maximum(level[got], mine) <= ask[whose]
            shared = np.bincount(whose[fits], minlength=i)[:i]
            pairs = np.flatnonzero(open_pairs & (shared >= ask))
            if not len(pairs):
                continue
            if len(pairs) > 16:
                every = owner[self._lists(by_code, list_starts, code[own])]
                both = np.bincount(every[every < i], minlength=i)[pairs]
            else:
                both = np.array([np.isin(self.tokens[self.starts[j] : self.starts[j + 1]], self.tokens[own]).sum() for j in pairs])
            linked = pairs[100 * both >= percent * (self.n[pairs] + self.n[i] - both)]
            for j in linked:
                if root[j] != root[i]:
                    out.append((int(self.classes[j]), int(self.classes[i])))
                    root[root == root[i]] = root[j]
        return out

    @staticmethod
    def _lists(by_code: np.ndarray, list_starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places of all tokens with one of ``codes``, list after list."""
        lo, hi = list_starts[codes], list_starts[codes + 1]
        size = hi - lo
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return by_code[np.repeat(lo, size) + step]


def _links(docs: DataFrame, needed: DataFrame, words: int, percent: int, sketch) -> DataFrame:
    """Links ``a, b`` between classes that meet and are similar."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sketch.value
        for batch in batches:
            for lo, hi, flat in flat_slices(batch.column("text")):
                doc, hashes = _ordered(*shingle_sets(flat, words), order)
                starts = np.searchsorted(doc, np.arange(flat.n + 1))
                for i, meetings in enumerate(batch.column("meetings").slice(lo, hi - lo).to_pylist()):
                    tokens = hashes[starts[i] : starts[i + 1]]
                    if not len(tokens):
                        continue
                    wanted = matches_wanted(tokens, len(tokens), percent, order)
                    m = len(meetings)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["group"] for x in meetings]), pa.array([x["part"] for x in meetings]),
                         pa.array([batch.column("class")[lo + i].as_py()] * m), pa.array([wanted] * m, pa.int32()),
                         pa.array([tokens.tobytes()] * m, pa.binary())],
                        names=["group", "part", "class", "wanted", "tokens"],
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["group", "part"]):
            classes, index = np.unique(table.column("class").to_numpy(), return_index=True)
            if len(classes) < 2:
                continue
            sets = [np.frombuffer(table.column("tokens")[int(i)].as_buffer(), dtype=np.uint64) for i in index]
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            wanted = table.column("wanted").to_numpy()[index]
            found = Meeting(classes, starts, np.concatenate(sets), wanted).links(percent)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in found]), pa.array([b for _, b in found])], names=["a", "b"]
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    joined = keyed.join(
        needed.hint("shuffle_hash"),
        keyed["doc_id"].eqNullSafe(needed["rep_id"]) & (keyed["text_hash"] == needed["rep_hash"]),
    ).select("class", "meetings", "text")
    sent = joined.mapInArrow(spread, "group long, part long, class long, wanted int, tokens binary")
    return (
        sent.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(meet, "a long, b long")
    )


def _labelled(docs: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """``doc_id, text_hash, n, component, component_id`` of every row; the last two are null for empty sets."""
    context = docs.sparkSession.sparkContext
    sketch = context.broadcast(_sketch(docs, words))
    rows = shared_table(_sets(docs, words, percent, sketch))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = rows.filter("n > 0").groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "wanted", "prefix")])
    owners = rows.filter("n > 0").groupBy("class").agg(first)
    meetings = _meetings(shared_table(classes), percent, block).groupBy("class").agg(F.collect_list(F.struct("group", "part")).alias("meetings"))
    needed = meetings.join(owners, "class").select(
        "class", F.col("first.doc_id").alias("rep_id"), F.col("first.text_hash").alias("rep_hash"), "meetings"
    )
    linked = components(_links(docs, needed, words, percent, sketch))
    ids = owners.select(F.col("class").alias("node"), F.col("first.doc_id").alias("rep_id"))
    named = ids.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    labels = named.join(lowest, "component").select(F.col("node").alias("class"), "component", "component_id")
    return rows.drop("prefix", "wanted").join(labels, "class", "left").drop("class")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``(doc_id, text)``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct shingles of ``words``
    words (A-Z in lower case). ``component_id`` is the smallest id that can be reached over links, the own one included.
    A text with fewer words is one shingle; a null text or one without words has none and links to nothing. Repeated rows
    are equal sets and thus linked. Null ids are carried along: they can reach others, but are never the smallest id
    unless no other is there. An empty table gives no rows; other columns are not looked at.
    """
    return _labelled(docs, words, percent, block).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay when each group of linked documents keeps one: that with the smallest id (null
    last), all columns as they are. Documents without words are groups of their own. Of rows with the same id and text
    one stays.
    """
    rows = _labelled(docs, words, percent, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    linked = rows.filter("n > 0").groupBy("component").agg(first).select("first.doc_id", "first.text_hash")
    empty = rows.filter("n = 0").select("doc_id", "text_hash").distinct()
    stay = linked.union(empty).select(F.col("doc_id").alias("_stay_id"), F.col("text_hash").alias("_stay_hash"))
    keyed = docs.withColumn("_stay_text", F.xxhash64("text"))
    kept = keyed.join(
        stay.hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("_stay_id")) & (F.col("_stay_text") == F.col("_stay_hash")),
        "left_semi",
    )
    return kept.dropDuplicates(["doc_id", "_stay_text"]).select(*docs.columns)
