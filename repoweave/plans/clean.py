"""Cleaning steps of a run: copies, benchmark passages, personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.operators.decontaminate import without_benchmark
from repoweave.operators.dedup import exact_groups, near_components
from repoweave.operators.joins import attach
from repoweave.operators.redact import redact
from repoweave.session import shared_checkpoint

EXACT, NEAR = "exact", "near"


def _key() -> Column:
    """Sorts like the manifest entry, then the path."""
    return F.concat_ws(":", F.lpad(F.col("repo_ord").cast("string"), 10, "0"), "file_path").alias("key")


def _copies(chosen: DataFrame, how: str) -> DataFrame:
    """``key`` of files of which an earlier one holds the same, or nearly the same, text."""
    if how == EXACT:
        texts = chosen.filter(F.col("content") != "")
        first = exact_groups(texts, "key", "content").select(F.col("first_key").alias("key"))
        return texts.select("key").join(first, "key", "left_anti")
    found = near_components(chosen, "key", "content")
    return found.filter("key <> component").select("key")


def rejected_files(
    files: DataFrame, deduplicate: str | None = None, benchmark: DataFrame | None = None, benchmark_text: str = "text"
) -> DataFrame:
    """``key, reason`` of selected files that do not enter the corpus: copies (``deduplicate`` is ``exact`` or ``near``), and
    files that share a passage with ``benchmark``. Of several copies the one of the earliest entry and path stays; empty files
    are no copies of each other. Names only."""
    if deduplicate not in (None, EXACT, NEAR):
        raise ValueError(f"unknown way to find copies: {deduplicate!r}")
    chosen = files.filter("selected").select(_key(), "content")
    parts = []
    if benchmark is not None:
        clean = without_benchmark(chosen, "key", "content", benchmark, benchmark_text).select("key")
        leaked = shared_checkpoint(chosen.select("key").join(clean, "key", "left_anti"))
        parts.append(leaked.withColumn("reason", F.lit("holds a benchmark passage")))
        chosen = chosen.join(leaked, "key", "left_anti")
    if deduplicate:
        copies = _copies(chosen, deduplicate)
        parts.append(copies.withColumn("reason", F.lit(f"{deduplicate} copy of another file")))
    if not parts:
        return files.sparkSession.createDataFrame([], "key string, reason string")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return shared_checkpoint(found)


def clean_files(files: DataFrame, rejected: DataFrame | None = None, redacted: bool = False) -> DataFrame:
    """``files`` with rejected ones no longer ``selected``: they take part in the import graph only. With ``redacted``, personal
    data in the text gives way to marks."""
    if rejected is not None:
        marked = rejected.select(F.col("key").alias("_key"), F.lit(True).alias("_out"))
        files = attach(files.withColumn("_key", _key()), marked, ["_key"], "left").withColumn(
            "selected", F.col("selected") & F.col("_out").isNull()
        ).drop("_key", "_out")
    return redact(files, "content", counts=False) if redacted else files


def cleaning_rejects(files: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rejects of the cleaning steps."""
    return files.select("repo_name", "rel_path", _key()).join(rejected, "key").select(
        "repo_name", "rel_path", F.lit("clean").alias("stage"), "reason"
    )
