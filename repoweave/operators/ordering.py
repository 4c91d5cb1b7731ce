"""The order of files: dependency order, shuffle within a repository, shuffle over everything.

A DataFrame has no order of its own, so an ordering is either a sortable ``order_key`` (computed in place, no
shuffle) or an explicit dense position (one narrow range sort, see ``numbering``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions.records import shuffle_key
from repoweave.functions.text import file_name, folder_of
from repoweave.operators.numbering import number_rows

# Rank of files that are not in the graph: behind every level.
OUTSIDE_GRAPH = 1


def shuffle_global(files: DataFrame, seed: int) -> DataFrame:
    """Position of every file in one seeded shuffle: ``(repo_name, file_path, pos)``."""
    keys = files.select("repo_name", "file_path", shuffle_key(seed, F.col("file_path")).alias("_draw"))
    return number_rows(keys, ["_draw", "file_path", "repo_name"]).drop("_draw")


def shuffle_in_repo(files: DataFrame, seed: int) -> DataFrame:
    """Position of every file in its repository's own shuffle: ``(repo_name, file_path, pos)``."""
    keys = files.select("repo_name", "file_path", shuffle_key(seed, F.col("file_path")).alias("_draw"))
    return number_rows(keys, ["_draw", "file_path"], group_by=["repo_name"]).drop("_draw")


def dependency_rank(level: Column) -> Column:
    """Ascending rank that puts imported files before their importers and files outside the graph last."""
    return F.coalesce(-level, F.lit(OUTSIDE_GRAPH).cast("long"))


def order_files(paths: DataFrame, levels: DataFrame) -> DataFrame:
    """Position of every file in dependency order: ``(repo_name, rel_path, level, pos)``.

    ``levels`` covers the graph's nodes; a file without a level comes last. Ties are broken by path.
    """
    ranked = (
        paths.select("repo_name", "rel_path")
        .join(levels, ["repo_name", "rel_path"], "left")
        .withColumn("_rank", dependency_rank(F.col("level")))
    )
    return number_rows(ranked, ["_rank", "rel_path"], group_by=["repo_name"]).drop("_rank")


def walk_key(path: Column) -> Column:
    """Sort key of a sorted directory walk: a folder's own files before those of its subfolders."""
    return F.struct(F.split(folder_of(path), "/").alias("folder"), file_name(path).alias("name"))


def order_by_walk(paths: DataFrame) -> DataFrame:
    """Position of every file in sorted walk order: ``(repo_name, rel_path, pos)``."""
    keyed = paths.select("repo_name", "rel_path", walk_key(F.col("rel_path")).alias("_walk"))
    return number_rows(keyed, ["_walk"], group_by=["repo_name"]).drop("_walk")


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by a hash of ``key``; the same rows whatever the partitioning."""
    return df.orderBy(shuffle_key(seed, F.col(key).cast("string")), key).limit(n)
