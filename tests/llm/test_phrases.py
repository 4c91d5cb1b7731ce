"""Collocations against counts of every stretch of words."""

import ctypes
import os
import random
import re
from collections import Counter

import pytest

from repoweave.llm import phrases
from tests.llm import data

SCHEMA = "text string, lang string"


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", data.lower(text or "")):
        yield re.findall(r"[^\x20\x09]+", piece)


def inside(small, large):
    return any(large[i : i + len(small)] == small for i in range(len(large) - len(small) + 1))


def plain(rows, longest, min_count, percent, most):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        of = counts.setdefault(lang, Counter())
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                of.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, of in counts.items():
        candidates = [p for p, a in of.items() if len(p) > 1 and a >= min_count]
        rows = []
        for p in candidates:
            if any(len(q) > len(p) and 100 * of[q] >= percent * of[p] and inside(p, q) for q in candidates):
                continue
            score, k = min((1000 * of[p] * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -of[p], " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[:most]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return out


def random_rows(seed):
    rng = random.Random(seed)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my"
    rows = []
    for _ in range(120):
        words = [rng.choice(["the", "of", "a", "b", "c", "Old", "mill", "naïve", "x1"]) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.3:
            words.insert(rng.randint(0, len(words)), passage)
        if rng.random() < 0.1:
            words.append("tick tock " * 4)
        rows.append((rng.choice([" ", "  ", ", ", "\t", "\n"]).join(words), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize(("longest", "min_count", "percent", "most"), [(5, 4, 100, 2000), (5, 6, 60, 7), (3, 3, 100, 50), (2, 5, 100, 2000)])
def test_against_all_stretches(spark, longest, min_count, percent, most):
    rows = random_rows(longest + min_count) + [r[1:3] for r in data.odd_rows()] * 2
    docs = data.clashing(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("class", "phrase").repartition(5)
    got = phrases.collocations(docs, longest, min_count, percent, most)
    data.same(got.collect(), plain(rows, longest, min_count, percent, most))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    blank = spark.createDataFrame([(None, "en"), ("", None), (" \t.\n", "de")], SCHEMA)
    assert phrases.collocations(empty).collect() == phrases.collocations(blank, min_count=1).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 * a * n / (l * r) where the products do not fit a long."""
    big = 3_000_000_000
    row = spark.createDataFrame([(big, big * 5, big + 1, big + 2)], "a long, n long, l long, r long")
    wide = {c: phrases.F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    assert row.select(phrases.score(wide)).first()[0] == 1000 * big * big * 5 // ((big + 1) * (big + 2))


@pytest.mark.parametrize("known", [[], ["the", "b", "passage"]])
def test_edges_cover_each_word_once_and_flow_gives_all_counts(spark, known):
    """Weights of edges and corrections add up to the words; counts of one word follow from the flow alone."""
    rows = [(t, "en") for t, _ in random_rows(3)]
    texts = spark.createDataFrame(rows, SCHEMA).selectExpr("lang", "xxhash64(lang) lang_hash", "text")
    every = spark.sparkContext.broadcast(phrases.np.full(1 << (phrases.FILTER_BITS - 3), 255, dtype="uint8"))
    codes = spark.sparkContext.broadcast(known)
    edges = phrases._edges(texts, every, codes, 5)
    words = Counter(w for t, _ in rows for piece in pieces(t) for w in piece)
    assert sum(int.from_bytes(r.edge[-4:], "big") for r in edges.collect()) == sum(words.values())
    assert {r.phrase: r.n for r in phrases.phrase_counts(edges, codes, 5, 1).filter("size = 1").collect()} == words


def test_hot_pairs_are_dealt_out_and_added_up(spark):
    """All pairs taken as hot, or none: the same counts from more buckets."""
    texts = spark.createDataFrame([(t, "en") for t, _ in random_rows(4)], SCHEMA).selectExpr("lang", "xxhash64(lang) lang_hash", "text")
    every = spark.sparkContext.broadcast(phrases.np.full(1 << (phrases.FILTER_BITS - 3), 255, dtype="uint8"))
    codes = spark.sparkContext.broadcast(["of"])
    hot = phrases.np.array([r.pair for r in phrases._word_counts(texts, 1).filter("pair is not null").collect()]).view("uint64")
    both = [phrases._edges(texts, every, codes, 5), phrases._edges(texts, every, codes, 5, hot)]
    buckets = [e.selectExpr("substring(edge, 1, 4)").distinct().count() for e in both]
    assert len(hot) and buckets[1] > buckets[0]
    data.same(*[phrases.phrase_counts(e, codes, 5, 2).collect() for e in both])


def test_only_what_may_be_frequent_is_sent_on(spark):
    """Pairs that are rare are finished where they are; a word is sent once by each task, not by each pair. Edges that are met in
    several batches add up."""
    texts = spark.createDataFrame([(t, "en") for t, _ in random_rows(5)], SCHEMA).selectExpr("lang", "xxhash64(lang) lang_hash", "text")
    every = spark.sparkContext.broadcast(phrases.np.full(1 << (phrases.FILTER_BITS - 3), 255, dtype="uint8"))
    codes = spark.sparkContext.broadcast(["the", "of"])
    edges = phrases._edges(texts, every, codes, 5)
    words = {w for t, _ in random_rows(5) for piece in pieces(t) for w in piece}
    parts = phrases.phrase_parts(edges, codes, 5, 10**6)
    assert 0 < parts.count() <= len(words) * parts.rdd.getNumPartitions()
    whole = phrases.phrase_counts(edges, codes, 5, 2).collect()
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data.same(phrases.phrase_counts(edges, codes, 5, 2).collect(), whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_single_words_are_not_sent_by_the_flow(spark, monkeypatch):
    """Their counts are known before; sent by each task, they were as many rows as tasks times words."""
    parts, kept = phrases.phrase_parts, []
    monkeypatch.setattr(phrases, "phrase_parts", lambda *a, **k: kept.append(parts(*a, **k)) or kept[-1])
    docs = spark.createDataFrame(random_rows(6), SCHEMA)
    data.same(phrases.collocations(docs, 5, 4, 100, 2000).collect(), plain(random_rows(6), 5, 4, 100, 2000))
    assert {r["size"] for r in kept[0].select("size").distinct().collect()} == {2, 3, 4, 5}


@pytest.mark.parametrize(("parts", "held", "block"), [(1, 1 << 20, 1 << 16), (7, 1 << 20, 9), (3, 5, 1 << 16)])
def test_edges_travel_in_blocks(spark, monkeypatch, parts, held, block):
    """However they are gathered and cut, blocks give the edges that stand in the texts; a partition has all of a pair, and an edge
    takes fewer bytes than its words."""
    monkeypatch.setattr(phrases, "HELD_EDGES", held)
    monkeypatch.setattr(phrases, "BLOCK_EDGES", block)
    rows = [r for r in random_rows(8) if r[1] is not None] * 20
    texts = spark.createDataFrame(rows, "text string, lang string").selectExpr("lang", "xxhash64(lang) lang_hash", "text")
    every = spark.sparkContext.broadcast(phrases.np.full(1 << (phrases.FILTER_BITS - 3), 255, dtype="uint8"))
    codes = spark.sparkContext.broadcast(["of", "alpha", "the", "old"])
    monkeypatch.setattr(phrases, "SHORT_CODES", 2)
    wanted = Counter()
    for text, lang in rows:
        for w in pieces(text):
            wanted.update((lang, *w[i : i + 5]) for i in range(len(w)))
    blocks = phrases._blocks(texts, every, codes, 5, phrases.np.zeros(0, dtype="uint64"), parts).collect()
    got, at = Counter(), {}
    for row in blocks:
        assert 0 < row.n <= block
        planes = phrases.np.frombuffer(phrases.pa.decompress(row.edges, 32 * row.n, codec="zstd"), dtype="uint8").reshape(8, 4, row.n)
        columns = sum(planes[:, i].astype(int) << (8 * i) for i in range(4))
        words = ["", *codes.value, *row.spelled]
        for lang, *numbers, part, n in columns.T.tolist():
            edge = (row.langs[lang], *(words[i] for i in numbers if i))
            got[edge] += n
            assert part == 0 and at.setdefault(edge[:3], row["at"]) == row["at"] < parts
    assert got == wanted
    if block > 9 and held > 5:
        assert sum(len(r.edges) for r in blocks) < sum(len(" ".join(e)) for e in wanted)


def anonymous_mb():
    with open("/proc/self/smaps_rollup") as rollup:
        return int(re.search(r"\nAnonymous:\s+(\d+)", rollup.read())[1]) / 1024


def free_mb():
    """What allocators kept though it is free; they give it back here."""
    before = anonymous_mb()
    phrases.pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    return before - anonymous_mb()


@pytest.mark.skipif(not (os.path.exists("/proc/self/smaps_rollup") and hasattr(ctypes.CDLL(None), "malloc_trim")), reason="needs Linux, glibc")
@pytest.mark.parametrize("step", [0, 2])
def test_steps_leave_no_free_memory_in_a_worker(spark, monkeypatch, step):
    """Workers are kept, and an executor has several of them: one for each Python step that runs at a time."""
    docs, steps = spark.createDataFrame(random_rows(12), SCHEMA), []
    made = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: steps.append(f) or made(self, f, *a, **k))
    phrases.collocations(docs, 5, 4, 100, 2000).collect()
    assert [f.__name__ for f in steps[:5]] == ["scan", "digest", "scan", "lay_out", "flow"]
    lang_hash = docs.selectExpr("xxhash64('en')").first()[0]
    text = " ".join(random.Random(step).choices(["the", "of", "a", "b", "c", "mill", "x1"], k=60_000))
    batch = phrases.pa.RecordBatch.from_pydict({"lang": ["en"] * 80, "lang_hash": [lang_hash] * 80, "text": [text] * 80})
    free_mb()
    assert sum(b.num_rows for b in steps[step](iter([batch]))) > 0
    assert free_mb() < 10


def test_codes_are_told_apart_and_ordered_by_count(spark):
    numbers = [0, 1, 255, 256, phrases.SHORT_CODES - 1, phrases.SHORT_CODES, phrases.MOST_CODES - 1, None]
    codes = [phrases.code_of(n, "naïve\x01".encode()) for n in numbers]
    assert phrases.split_codes(b"".join(codes)) == codes and len(set(codes)) == len(codes)
    assert not any(x != y and y.startswith(x) for x in codes for y in codes)
    rows = [("en", f"w{i}", 1 << i) for i in range(10)] + [("de", "w9", 5)]
    frequent = spark.createDataFrame(rows, "lang string, word string, n long")
    assert phrases._codes(frequent, 100) == [f"w{i}" for i in reversed(range(10))]
    assert phrases._codes(frequent, 3) == ["w9", "w8", "w7"] and phrases._codes(frequent, 0) == []


def test_a_vocabulary_that_is_too_small_changes_nothing(spark, monkeypatch):
    rows = random_rows(11)
    monkeypatch.setattr(phrases, "MOST_CODES", 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    data.same(phrases.collocations(docs, 5, 4, 100, 2000).collect(), plain(rows, 5, 4, 100, 2000))


def test_unary_paths(spark):
    """A long passage is one path (in parts), a branch and a change of weight end one, a circle stays in single edges."""

    def edges(words, n):
        return [("en", " ".join(words[i : i + 3]), n) for i in range(len(words) - 2)]

    long = [f"w{i}" for i in range(150)]
    rows = edges(long, 7) + edges("p q r s t".split(), 3) + edges("s t u v".split(), 2) + edges("a b c a b".split(), 4) + [("en", "z z z", 9)]
    found = phrases.unary_paths(spark.createDataFrame(rows, "lang string, phrase string, n long"), 3).collect()
    assert all(r.lang == "en" for r in found)
    covered = Counter((" ".join(w[i : i + 3]), r.n) for r in found for w in [r.passage.split()] for i in range(len(w) - 2))
    assert covered == Counter((p, n) for _, p, n in rows)
    sizes = {r.passage.split()[0]: len(r.passage.split()) - 2 for r in found}
    assert [sizes[k] for k in ("w0", "w64", "w128")] == [64, 64, 20]
    assert sizes["p"] == 3 and sizes["s"] == 2 and sizes["z"] == 1
    assert sum(r.n == 4 for r in found) == 3
