"""The stages of the corpus, each on the real output of the one before, against plain counterparts."""

import pytest

import corpus_pipeline
from repoweave.llm import quality, secrets
from tests.llm import data

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of the documents and after each stage, written and read again in between."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        result = stage(spark, docs, SF_DIR)
        assert result.columns[:5] == COLUMNS and (name == "source_mix" or len(result.columns) == 5)
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_quality_rules(spark, stages):
    found = quality.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    import numpy as np
    import pyarrow as pa

    expected = set()
    for r in stages[0]:
        n, chars, symbols, duplicates, repeats = data.quality_counts(r.text)
        _, _, flat = next(quality.flat_slices(pa.array([r.text or ""])))
        more = {k: int(v[0]) for k, v in quality.counts_of(flat, quality._hash_words(found.flagged)).items()}
        assert (more["n_words"], more["word_chars"], more["n_symbols"]) == (n, chars, symbols)
        assert (more["n_dup_lines"], more["n_repeat_words"]) == (duplicates, repeats)
        share = lambda a, b: more[a] / more[b] if more[b] else 0.0  # noqa: B023, E731
        x = np.array([[
            n, share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"),
            share("n_repeat_words", "n_words"), share("n_upper", "n_letters"), share("n_digits", "n_chars_all"),
            share("n_marks", "n_words"), share("n_distinct", "n_words"), share("n_words", "n_lines"), more["n_flagged"],
        ]])
        failed = n < 50 or 100 * repeats > 50 * n
        if not failed and not any(quality._covers(rule, x)[0] for rule in found.rules):
            expected.add(r.doc_id)
    assert {r.doc_id for r in stages[1]} == expected and len(stages[1]) == len(expected)


def test_near_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    expected = {c for _, _, c in data.components(rows, 5, 80)}
    assert sorted(r.doc_id for r in stages[2]) == sorted(expected)


def test_benchmark_leaks(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages[2] if not any(t in r.text for t in items)}
    assert {r.doc_id for r in stages[3]} == clean


def test_secret_masks(stages):
    before = {r.doc_id: r for r in stages[3]}
    assert len(stages[4]) == len(stages[3])
    for r in stages[4]:
        spans = secrets.base_spans(before[r.doc_id].text)
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not spans and "[SECRET]" not in r.text:
            assert r == before[r.doc_id]


def test_source_mix(stages):
    size = {r.doc_id: len(data.WORD.findall(r.text)) for r in stages[4]}
    source = {r.doc_id: r.source for r in stages[4]}
    sizes, taken, copies = {}, {}, {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    for r in stages[5]:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(len(c))) and len(c) <= 3 for c in copies.values())
    order = sorted(sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(3 * sizes[s] for s in full), [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        largest = max(size[i] for i in size if source[i] == s)
        target = share.get(s, 3 * sizes[s])
        assert target - largest <= taken.get(s, 0) <= target + 1e-6
