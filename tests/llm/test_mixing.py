"""The mix of sources, and the queries that SQL can check."""

import pytest
from pyspark.sql import functions as F

from repoweave.llm import mixing, oracles
from repoweave.llm.queries import ORACLES, QUERIES
from tests.check import compare, oracle_connection
from tests.llm import data

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, name):
    assert compare(spark, oracle_connection(SF_DIR), name, SF_DIR)[0] is True


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Excess over the limits is dealt out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in order}
        full |= over


def test_targets_of_odd_rows(spark):
    plan = mixing.mix_plan(data.clashing(data.odd(spark))).collect()
    sizes = {}
    for r in data.odd_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(data.WORD.findall(r[1] or ""))
    expected = plain_targets(sizes)
    assert len(plan) == len(data.odd_rows())
    for r in plan:
        assert r.target == pytest.approx(expected[r.source]) and r.taken <= 3 * r.size
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))


def test_taken_words_come_near_the_target_and_reruns_agree(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.mix_plan(d).toPandas()
    by = plan.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 0.02 * by.target).all()
    again = mixing.mix_plan(d.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert plan[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_sources_end_within_their_smallest_document_of_the_target(spark, scale):
    """Sizes and targets by SQL; nothing that may have another copy fits any more, and nothing overshoots."""
    sf_dir = f"/root/testdata/sf{scale}"
    con = oracle_connection(sf_dir)
    plan = QUERIES["op5_source_mix"](spark, sf_dir).toPandas()
    con.register("plan", plan)
    con.execute(f"create table expected as {oracles.SOURCE_TARGETS}")
    off = con.execute("""select count(*) from expected e full join plan p using (doc_id)
        where e.size is distinct from p.size or e.source_size is distinct from p.source_size or not abs(e.target - p.target) < 1e-6
           or p.taken > 3 * p.size or (p.size > 0 and p.taken % p.size <> 0)""").fetchone()
    assert off == (0,) and len(plan) == con.execute("select count(*) from documents").fetchone()[0]
    short = con.execute("""select source, max(e.target) - sum(p.taken), min(p.size) filter (where p.size > 0 and p.taken < 3 * p.size)
        from expected e join plan p using (doc_id) group by source""").fetchall()
    assert len(short) == 20
    for _, missing, smallest in short:
        assert -1e-6 <= missing < (smallest if smallest is not None else 1e-6)


def test_shares_of_inclusion_over_200_draws(spark):
    """Each draw is a group of its own. Chances are the fractional parts, sizes are equal, so the sample has a fixed number."""
    chances = [0.1, 0.25, 0.5, 0.75, 0.9] * 12
    rows = [(i, 10, p, f"s{seed}", 10.0 * sum(chances)) for seed in range(200) for i, p in enumerate(chances)]
    due = spark.createDataFrame(rows, "doc_id long, size long, due double, g string, target double")
    due = due.withColumn("u", mixing.uniform(F.concat("g", F.lit("/"), "doc_id")))
    got = mixing.pareto_copies(due, ["g"], "target").toPandas()
    assert set(got.groupby("g").copies.sum()) == {30} and got.copies.max() == 1
    for p, share in got.groupby("due").copies.mean().items():
        assert abs(share - p) < 0.03


def test_short_documents_are_due_more_and_the_words_stay(spark):
    sizes = [1, 10, 100, 1000, 5000] * 40
    docs = spark.createDataFrame([(i, "w " * n, "ab"[i % 2]) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, weights=(2, 3)).toPandas()
    mean = plan.groupby(["source", "size"]).copies.mean().unstack()
    assert (mean[1] > mean[100]).all() and (mean[100] > mean[5000]).all()
    by = plan.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.target - by.taken).between(0, 1)).all()


def test_unequal_chances_follow_the_amount_due(spark):
    rows = [(i, 10, 0.2 if i % 2 else 0.8, "g", 5000.0) for i in range(1000)]
    due = spark.createDataFrame(rows, "doc_id long, size long, due double, g string, owed double")
    due = due.withColumn("u", mixing.uniform(due["doc_id"]))
    got = mixing.pareto_copies(due, ["g"], "owed").toPandas()
    assert got.copies.sum() == 500
    assert 370 <= got[got.due > 0.5].copies.sum() <= 430


def test_mix_repeats_rows(spark):
    df = data.clashing(data.odd(spark))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copy"]
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mix_plan(df.limit(0)).collect() == []
    assert {r.doc_id for r in mixed.collect()} <= {r[0] for r in data.odd_rows()}
