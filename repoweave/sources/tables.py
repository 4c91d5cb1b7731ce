"""Stored corpora, rankings and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoweave.functions.records import RECORD_SCHEMA

PACKAGE_LIST = "rows array<struct<project: string, download_count: bigint>>"
SEARCH_PAGE = (
    "items array<struct<name: string, html_url: string, stargazers_count: bigint, has_issues: boolean, size: bigint, "
    "description: string>>"
)


def read_corpus(
    spark: SparkSession, path: str, multiline: bool = False, schema: T.StructType = RECORD_SCHEMA, glob: str | None = None
) -> DataFrame:
    """A finished corpus: JSON Lines, read in splits, or with ``multiline`` JSON arrays, one task per file.

    The form is the caller's to say, and a row that does not parse raises. ``glob`` picks files by name, so a folder that
    holds both forms is the union of two reads.
    """
    reader = spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def package_rows(documents: DataFrame, base: str = "first_row") -> DataFrame:
    """Ranking documents ``(first_row, json)`` to rows ``(row_ord, project, download_count)``.

    A ranking kept in several documents says where each one starts.
    """
    parsed = documents.select(F.col(base), F.from_json("json", PACKAGE_LIST).alias("d"))
    return parsed.select(base, F.posexplode("d.rows").alias("at", "r")).select(
        (F.col(base) + F.col("at")).alias("row_ord"), "r.project", "r.download_count"
    )


def read_package_ranking(spark: SparkSession, path: str) -> DataFrame:
    """A ranking file ``{"rows": [...]}``."""
    text = spark.read.text(path, wholetext=True)
    return package_rows(text.select(F.lit(0).cast("long").alias("first_row"), F.col("value").alias("json")))


def search_items(pages: DataFrame) -> DataFrame:
    """Stored search pages ``(page, json)`` to items ``(page, at, name, ...)``."""
    parsed = pages.select("page", F.from_json("json", SEARCH_PAGE).alias("d"))
    return parsed.select("page", F.posexplode("d.items").alias("at", "item")).select("page", "at", "item.*")


def items_per_page(pages: DataFrame) -> DataFrame:
    return pages.select("page", F.size(F.from_json("json", SEARCH_PAGE)["items"]).cast("long").alias("n_items"))


def write_search_pages(pages: DataFrame, path: str) -> None:
    """Store search pages ``(page, json)`` many to a file, one line each: a crawl of a million pages is a few files."""
    pages.select("page", "json").write.json(path)


def read_search_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items of pages stored by ``write_search_pages``."""
    return search_items(spark.read.schema("page long, json string").option("mode", "FAILFAST").json(path))


def read_search_pages(spark: SparkSession, path: str, page_pattern: str = r"(\d+)[^/0-9]*$") -> DataFrame:
    """Stored search responses, one JSON document per file. ``page_pattern`` finds the page number in a file's path, by
    default the last number in it."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return search_items(
        text.select(F.regexp_extract("file", page_pattern, 1).cast("long").alias("page"), F.col("value").alias("json"))
    )
