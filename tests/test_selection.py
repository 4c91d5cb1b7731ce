"""Repository and package selection."""

import pytest
from pyspark.sql import functions as F

from repoweave.functions.imports import extension_of
from repoweave.operators import selection as sel

ITEM = "page long, at long, name string, html_url string, has_issues boolean, size long, description string"


@pytest.mark.parametrize(
    "text, invalid",
    [
        (None, True),
        ("", False),
        ("A fast parser", False),
        ("A MIRROR of x", True),
        ("latest tools", True),
        ("机器学习 课程", False),
        ("深度学习", True),
        ("用例", True),
        ("예제 모음", True),
        ("machine learning tutorial 机器学习", False),
    ],
)
def test_invalid_description(spark, text, invalid):
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(sel.invalid_description(F.col("d"))).first()[0] is invalid


def test_every_blacklisted_word_counts(spark):
    df = spark.createDataFrame([(f"x{w.upper()}y",) for w in sel.BLACKLIST], "d string")
    assert df.filter(~sel.invalid_description(F.col("d"))).count() == 0
    assert len(sel.BLACKLIST) == 58 and len(set(sel.BLACKLIST)) == 55


def test_top_repos_filter_before_limit(spark):
    rows = [(i // 7, i % 7, f"n{99 - i}", "u", i % 2 == 0, 100_000 + i % 3, "ok") for i in range(30)]
    got = [r.name for r in sel.top_repos(spark.createDataFrame(rows, ITEM).repartition(3), 4).collect()]
    kept = [n for _, _, n, _, issues, size, _ in rows if issues and size > 100_000]
    assert got == kept[:4]


def test_top_packages_is_stable(spark):
    rows = [(i, f"p{i}", i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "row_ord long, project string, download_count long").repartition(5)
    got = [r.project for r in sel.top_packages(df, 8).collect()]
    assert got == [p for _, p, _ in sorted(rows, key=lambda r: r[2], reverse=True)[:8]]


def test_manifest_repairs(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "b ", "y"), (2, "a", "z"), (3, "b", "w")], "repo_ord int, repo_name string, path string")
    assert sel.clean_manifest(df).count() == 4
    assert {tuple(r) for r in sel.clean_manifest(df, dedupe=True).collect()} == {(0, "a", "x"), (1, "b ", "y"), (3, "b", "w")}
    assert {tuple(r) for r in sel.clean_manifest(df, dedupe=True, trim=True).collect()} == {(0, "a", "x"), (1, "b", "y")}


def test_missing_and_unreachable(spark):
    manifest = spark.createDataFrame([("a", "u"), ("b", None)], "repo_name string, url string")
    present = spark.createDataFrame([("a",)], "repo_name string")
    assert [r.repo_name for r in sel.missing_repos(manifest, present).collect()] == ["b"]
    assert [tuple(r) for r in sel.unreachable(manifest).collect()] == [("b", None, "download", "no download link")]


def test_extensions(spark):
    df = spark.createDataFrame([("python",), ("java",), ("cobol",)], "l string")
    assert [r[0] for r in df.select(extension_of(F.col("l"))).collect()] == [".py", ".java", None]
