"""Runs against all periods of all texts; the query itself is held against SQL in test_mixing."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from repoweave.llm import periodic
from tests.llm import data


def plain_runs(w, exponent=2, least=2):
    """Maximal agreements at every distance; of equal stretches the smallest period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        x = 0
        while x + p < len(w):
            first = x
            while x + p < len(w) and w[x] == w[x + p]:
                x += 1
            if x - first >= p:
                found.setdefault((first, x + p - first), p)
            x += 1
    return sorted((s, n, p) for (s, n), p in found.items() if n >= max(least, exponent * p))


def random_words(rng):
    n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
    w = [rng.randrange(letters) for _ in range(n)]
    if n > 4 and rng.random() < 0.5:
        a = rng.randrange(n - 2)
        p = rng.randint(1, max(1, (n - a) // 3))
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_appended_words_in_any_pieces(piece):
    rng = random.Random(piece)
    for _ in range(400):
        w = random_words(rng)
        catchers = periodic.Catchers()
        for i in range(0, len(w), piece):
            catchers.append(np.array(w[i : i + piece]))
            assert piece > 1 or catchers.runs() == plain_runs(w[: i + 1])  # known as soon as a word is there
        assert catchers.runs() == plain_runs(w)
        assert catchers.runs(4, 6) == plain_runs(w, 4, 6)


@pytest.mark.parametrize("period", [1, 6, 5000, 30000])
def test_long_periodic_text_over_many_pieces(period):
    words = [f"x{i}" for i in range(777)] + [f"w{i % period}" for i in range(130_000)]
    assert periodic.runs_of(words, 4, 6) == [(777, 130_000, period)]


def test_thue_morse_words_have_no_run_of_four():
    words = [str(bin(i).count("1") & 1) for i in range(1 << 14)]
    assert periodic.runs_of(words, 4, 4) == []
    assert len(periodic.runs_of(words[:256])) == len(plain_runs(words[:256]))


def expected(doc_id, text):
    w = data.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = plain_runs(w, 4, 6)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
        digest(" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


def test_digests_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [r[:2] for r in data.odd_rows() if r[0] != 9]
    rows += [(i, " ".join(map(str, random_words(rng)))) for i in range(100, 160)]
    # Ties in length, two runs that overlap, one run to the last word, equal ids with other texts.
    rows += [(200, "a a a a a a b c c c c c c"), (200, "x " + "a b " * 5 + "b b b b b b"), (201, "q " + "r s t " * 4), (201, None)]
    docs = data.clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = periodic.digests(periodic.find_runs(periodic.with_periods(docs))).collect()
    data.same(got, [expected(*r) for r in rows])


def test_empty_table_and_one_long_text(spark):
    docs = data.odd(spark)
    assert periodic.digests(periodic.find_runs(periodic.with_periods(docs.limit(0)))).collect() == []
    one = spark.createDataFrame([("k", "la " * 300_000)], "doc_id string, text string")
    row = periodic.find_runs(one).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 1)] and row.collapsed == "la" and row.n_words == 300_000


def test_no_shuffle(spark):
    plan = periodic.find_runs(data.odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
