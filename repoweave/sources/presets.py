"""Preset manifests from a YAML configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MANIFEST_SCHEMA = "repo_ord int, repo_name string, url string, path string, extensions array<string>"


def preset_manifest(spark: SparkSession, repos: list[dict], repos_dir: str) -> DataFrame:
    """Manifest of a ``repos:`` section, a list of one-key maps, in file order. Names may repeat, as written."""
    rows = []
    for position, entry in enumerate(repos):
        (repo,) = list(entry.values())[:1]
        rows.append((position, repo["name"], repo["url"], f"{repos_dir}/{repo['path']}", list(repo["extensions"])))
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)
