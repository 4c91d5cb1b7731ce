"""Sketches against plain sets of paragraphs, and the whole query against a plain version of it."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from repoweave.llm import fingerprints as fp
from repoweave.llm.words import flat_slices
from tests.llm import data

SF_DIR = "/root/testdata/sf0.001"


def paragraphs(texts):
    return fp.Paragraphs.of(next(flat_slices(pa.array(texts, pa.string()), 1 << 40))[2])


def plain_sets(texts):
    """Digest and weight of each paragraph of each text, one text at a time."""
    out = []
    for text in texts:
        one = paragraphs([text])
        out.append(dict(zip(one.digest.tolist(), one.weight.tolist(), strict=True)))
    return out


def plain_likeness(a, b):
    both, either = sum(w for d, w in a.items() if d in b), sum({**a, **b}.values())
    return both / either if either else 1.0


def random_texts(rng, n):
    words = [f"w{i}" for i in range(400)] + ["ß", "日本"]
    return ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_paragraphs_are_lines_or_parts_of_them():
    text = "one two three four five six\n\n  one two three four five six\nseven"
    one = paragraphs([text])
    assert one.weight.sum() <= len(text) and len(set(one.digest.tolist())) == len(one.digest) >= 3
    joined = paragraphs(["", text, text + "\neight", " \t\n", "seven"])
    assert joined.count.tolist() == [0, len(one.digest), len(one.digest) + 1, 0, 1]
    assert set(joined.digest[joined.owner == 1]) == set(one.digest) < set(joined.digest[joined.owner == 2])


@pytest.mark.parametrize("seed", range(4))
def test_differences_are_those_of_the_sets(seed):
    rng = random.Random(seed)
    left = random_texts(rng, 40) + ["", "a b c", "", "x " * 5000]
    right = [t if rng.random() < 0.2 else t[: len(t) * 3 // 4] + rng.choice(left)[:90] for t in left[:-4]] + ["", "", "a b c", "x " * 4000]
    pair, digest, weight, sign = fp.differences(paragraphs(left), paragraphs(right))
    a, b = plain_sets(left), plain_sets(right)
    for i in range(len(left)):
        of = pair == i
        for s, x, y in ((1, a[i], b[i]), (-1, b[i], a[i])):
            got = dict(zip(digest[of & (sign == s)].tolist(), weight[of & (sign == s)].tolist(), strict=True))
            assert got == {d: w for d, w in x.items() if d not in y}
    like = fp.likeness(paragraphs(left), paragraphs(right), pair, weight)
    assert like.tolist() == pytest.approx([plain_likeness(x, y) for x, y in zip(a, b, strict=True)])


def test_small_sketch_fails_and_a_larger_one_recovers():
    left, right = paragraphs(["\n".join(f"line {i}" for i in range(900))]), paragraphs(["nothing of it"])
    small = fp.Sketch.of(left).minus(fp.Sketch.of(right)).peel()
    assert not small[-1][0]
    large = fp.Sketch.of(left, 2000).minus(fp.Sketch.of(right, 2000)).peel()
    assert large[-1][0] and len(large[1]) == len(left.digest) + len(right.digest)
    assert len(fp.differences(left, right)[1]) == len(left.digest) + len(right.digest)


def test_a_cell_that_only_looks_pure_is_left():
    sketch = fp.Sketch(1, 5)
    sketch.count[3], sketch.digest[3], sketch.check[3] = 1, 77, 5
    assert not sketch.peel()[-1][0]


def plain_rows(rows):
    """``(doc_id, n_chars, edited, near_edited, near_next)``; the next of a row is the next different one."""
    different = sorted({(i is not None, i or 0, tie, t) for i, t, tie in rows})
    after = {d: different[(k + 1) % len(different)] for k, d in enumerate(different)}
    out = []
    for i, t, tie in rows:
        following = after[i is not None, i or 0, tie, t][3]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = plain_sets([t, edited, following])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def check(docs):
    got = fp.near_versions(docs).collect()
    rows = [(r.doc_id, r.text or "", r.tie) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) tie").collect()]
    key = lambda r: (r[0] is not None, r[0], *r[1:])
    expected = sorted(plain_rows(rows), key=key)
    found = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key)
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    for column in (3, 4):
        assert [r[column] for r in found] == pytest.approx([r[column] for r in expected])
    return got


def test_whole_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    got = check(docs)
    assert fp.near_versions(docs.repartition(7)).exceptAll(fp.near_versions(docs)).count() == 0
    edited = np.array([[r.near_edited, r.near_next] for r in got])
    assert np.median(edited[:, 0]) > 0.5 > 0.1 > np.median(edited[:, 1])


def test_odd_rows(spark):
    docs = data.clashing(data.odd(spark).union(data.odd(spark).limit(3))).withColumnRenamed("block", "slice")
    docs = docs.withColumnRenamed("kept", "times").repartition(4)
    got = check(docs)
    by_text = {}
    for r in fp.fingerprints(docs).collect():
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert {r.fingerprint for r in got} == set().union(*by_text.values())
    assert by_text[1] == by_text[2] and len(by_text[1]) == 1 and by_text[5] == by_text[6]
    assert base64.b64decode(by_text[6].copy().pop())[:16] == bytes(16)


def test_empty_and_single_tables(spark):
    docs = data.odd(spark)
    assert fp.near_versions(docs.limit(0)).collect() == []
    alone = fp.near_versions(docs.filter("doc_id = 4")).first()
    assert alone.near_next == 1.0 and 0.4 < alone.near_edited < 1
    assert fp.near_versions(docs.filter("doc_id = 5")).first().near_edited == 1.0


def test_one_row_repeated_very_often_is_sent_once_a_batch(spark):
    docs = spark.range(4).selectExpr("id doc_id", "'some words here' text")
    many = docs.union(spark.range(0, 30_000, 1, 4).selectExpr("cast(null as long) doc_id", "'the same text' text"))
    assert fp.near_versions(many).groupBy("doc_id").count().orderBy("count").collect()[-1]["count"] == 30_000
    assert fp.with_next(many).count() == 5


def steps_of(spark, monkeypatch, docs):
    """The Python steps of the query, by name."""
    steps, made = {}, type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: steps.update({f.__name__: f}) or made(self, f, *a, **k))
    fp.near_versions(docs).collect()
    monkeypatch.undo()
    return steps


def test_slices_count_the_bytes_of_all_texts_of_a_row():
    texts = [pa.array(["", None, "ab", "", "x" * 50, "y"]), pa.array(["z" * 40, "", None, "w" * 30, "", "v"])]
    assert list(fp.row_slices(texts, 40)) == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert list(fp.row_slices([t.slice(2, 2) for t in texts], 1)) == [(0, 1), (1, 2)]
    assert list(fp.row_slices([t.slice(0, 0) for t in texts], 1)) == []


def test_rows_are_sent_and_compared_in_pieces(spark, monkeypatch):
    """A short text beside a long one does not make a slice of many long ones."""
    steps = steps_of(spark, monkeypatch, spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"))
    assert list(steps) == ["deal", "follow", "scan"]
    monkeypatch.setattr(fp, "SLICE_BYTES", 1000)
    n, text = 64, "some words " * 20
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * n, pa.int32()), pa.array([False] * n), pa.array([1] * n), pa.array(range(n)), pa.array([0] * n), pa.array([f"{i} {text}" for i in range(n)])],
        names=["slice", "ahead", "times", "doc_id", "tie", "text"],
    )
    pieces = list(steps["follow"](iter([batch])))
    assert max(p.nbytes for p in pieces) < 3000
    assert [i for p in pieces for i in p.column(0).to_pylist()] == list(range(n - 1))
    names = ["doc_id", "n_chars", "edited_sha256", "times", "text", "edited", "next_text"]
    row = [pa.array(range(n)), pa.array([1] * n), pa.array([""] * n), pa.array([1] * n), pa.array(["a"] * n), pa.array([text] * n), pa.array([text] * n)]
    found = list(steps["scan"](iter([pa.RecordBatch.from_arrays(row, names=names)])))
    assert max(b.num_rows for b in found) == 2 and sum(b.num_rows for b in found) == n


def test_digests_of_what_differs(spark):
    rows = [(1, "a\nb\nc", "a\nc\nd"), (2, None, "x"), (3, "same", "same")]
    found = fp.compare(spark.createDataFrame(rows, "id long, old string, new string"), "old", ["new"], ["id"], digests=True)
    got = {r.id: (len(r.new_removed), len(r.new_added), r.new_likeness) for r in found.collect()}
    assert got == {1: (1, 1, 0.5), 2: (0, 1, 0.0), 3: (0, 0, 1.0)}
