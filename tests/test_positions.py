"""Dense numbering, running totals and skewed joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from repoweave.operators.numbering import number_rows, running_total
from repoweave.operators.joins import hot_keys, salted_join


def rows(n=3000):
    rng = random.Random(5)
    # One group holds a third of everything.
    return [("hot" if i % 3 == 0 else f"g{rng.randint(0, 40)}", rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("partitions", ["1", "8", "31"])
def test_positions_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = rows()
        df = spark.createDataFrame(data, "g string, k int, id int, v int").repartition(5)
        got = {(r.g, r.id): r.pos for r in number_rows(df, ["-k", "id"], ["g"]).collect()}
        want, seen = {}, {}
        for g, k, i, _ in sorted(data, key=lambda r: (r[0], -r[1], r[2])):
            want[g, i] = seen.get(g, 0)
            seen[g] = want[g, i] + 1
        assert got == want

        totals = {r.id: r.running_total for r in running_total(df, F.col("v"), ["k", "-id"]).collect()}
        want, total = {}, 0
        for _, _, i, v in sorted(data, key=lambda r: (r[1], -r[2])):
            want[i] = total
            total += v
        assert totals == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hot_group_is_numbered_in_several_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows(), "g string, k int, id int, v int")
        sliced = df.repartitionByRange("g", "k", "id").withColumn("slice", F.spark_partition_id())
        assert sliced.filter("g = 'hot'").select("slice").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame(rows(600), "g string, k int, id int, v int")
    right = spark.createDataFrame([("hot", "a"), ("g1", "b"), ("g2", "c"), ("other", "d")], "g string, name string")
    plain = sorted(map(str, left.join(right, ["g"], how).collect()))
    assert sorted(map(str, salted_join(left, right, ["g"], ["id"], how, limit=20).collect())) == plain
    assert sorted(map(str, salted_join(left, right, ["g"], ["id"], how, rows=600).collect())) == plain
    hot = {r.g: r._slices for r in hot_keys(left, ["g"], 20).collect()}
    assert hot["hot"] == 10
