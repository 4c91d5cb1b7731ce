"""Shingle joins and suffix-array removal against plain counterparts."""

import hashlib
import random
from collections import defaultdict

import pytest

from repoweave.llm import jaccard, suffixes
from repoweave.llm.components import components
from tests.llm import data


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_components_of_odd_rows(spark, words, percent):
    df = data.clashing(data.odd(spark))
    got = jaccard.near_components(df, words, percent).collect()
    expected = data.components([(r[0], r[1]) for r in data.odd_rows()], words, percent)
    data.same(got, expected)


def edited(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("block", "small"), [(jaccard.BLOCK, jaccard.SMALL), (400, 4)])
def test_near_copies_in_clusters_pairs_and_blocks(spark, monkeypatch, block, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150])))
        rows += [edited(rng, base, rng.randrange(0, 5)) for _ in range(25)]
    rows = list(enumerate(rows, 100))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 90), (5, 80)):
        got = jaccard.near_components(df, words, percent, block).collect()
        data.same(got, data.components(rows, words, percent))


def test_one_of_each_keeps_columns_and_one_row_per_group(spark):
    df = data.clashing(data.odd(spark))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    ids = [i for i, _ in rows]
    # 1, 2 (twice), 3 and 13 are near copies or not by similarity; the null id loses to an id it links with.
    expected = data.components([(r[0], r[1]) for r in data.odd_rows()], 5, 80)
    assert sorted(i for i in ids if i is not None) == sorted({c for i, n, c in expected if n and c is not None} | {5, 6, 7})
    assert len([t for i, t in rows if i is None and t is None]) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], data.SCHEMA)
    assert jaccard.near_components(empty).collect() == []
    assert suffixes.remove_repeats(empty).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def test_rounds_of_components_keep_the_guessed_size_small(spark):
    """What rounds hand on has the size of its files, and is read in as few tasks as that needs."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(64)
    found = components(edges)
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 20
    assert {r.component for r in found.collect()} == {0} and found.count() == 301


def removed(texts, length):
    count = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(3)
    monkey = suffixes.LENGTH
    for _ in range(40):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = []
        for _ in range(rng.randrange(2, 6)):
            a = rng.randrange(50)
            texts.append(bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(10))) + base[a : a + rng.randrange(8, 60)])
        for depth, places in suffixes.repeat_groups(texts, 12):
            strings = {texts[k][p : p + depth] for k, p in places}
            assert len(strings) == 1
            string = strings.pop()
            every = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - depth + 1) if t[i : i + depth] == string]
            assert every == places
        spans = [suffixes._joined(s) for s in suffixes._covered(texts, [1] * len(texts), 12)]
        for s, e in zip(spans, removed(texts, 12), strict=True):
            assert (sum(b - a for a, b in s), len(s)) == e[1:3]
    assert monkey == 200


@pytest.mark.parametrize("bucket_bytes", [suffixes.BUCKET_BYTES, 300])
def test_removal_matches_brute_force(spark, bucket_bytes):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(90))
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + passage[rng.randrange(60) :]) for i in range(30)]
    rows += [(r[0], r[1]) for r in data.odd_rows() if r[0] != 9] + [(40, "x" * 900), (41, "ab" * 300)]
    df = data.clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = suffixes.remove_repeats(df, bucket_bytes=bucket_bytes).collect()
    expected = removed([(t or "").encode() for _, t in rows], 200)
    data.same(got, [(i, *e) for (i, _), e in zip(rows, expected, strict=True)])
