"""Counts over files, imports, graphs and tokens. All are partial-final aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.functions.text import language_of
from repoweave.operators.dependencies import drop_self_loops


def repo_stats(files: DataFrame) -> DataFrame:
    """Files per repository."""
    return files.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_files"))


def language_stats(files: DataFrame) -> DataFrame:
    """Files per repository and language."""
    return files.groupBy("repo_name", language_of(F.col("rel_path")).alias("language")).agg(
        F.count(F.lit(1)).alias("n_files")
    )


def import_counts(import_sets: DataFrame) -> DataFrame:
    """Distinct imports per source file; the sets are already distinct, so this is a projection."""
    return import_sets.select("repo_name", "rel_path", F.size("modules").cast("long").alias("n_imports"))


def graph_stats(nodes: DataFrame, edges: DataFrame, components: DataFrame, acyclic: DataFrame) -> DataFrame:
    """Per repository: nodes, edges, cyclic components, and edges removed to break them."""
    counted = [
        nodes.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_nodes")),
        edges.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n_edges")),
        components.groupBy("repo_name", "scc_id")
        .agg(F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") > 1)
        .groupBy("repo_name")
        .agg(F.count(F.lit(1)).alias("n_cyclic_components")),
        drop_self_loops(edges).groupBy("repo_name").agg(F.count(F.lit(1)).alias("_plain")),
        acyclic.groupBy("repo_name").agg(F.count(F.lit(1)).alias("_kept")),
    ]
    joined = counted[0]
    for part in counted[1:]:
        joined = joined.join(part, "repo_name", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "repo_name",
        "n_nodes",
        F.coalesce("n_edges", zero).alias("n_edges"),
        F.coalesce("n_cyclic_components", zero).alias("n_cyclic_components"),
        (F.coalesce("_plain", zero) - F.coalesce("_kept", zero)).alias("n_cycle_edges"),
    )


def token_stats(tokenized: DataFrame) -> DataFrame:
    """Rows, total and average tokens per row."""
    length = F.size("input_ids").cast("long")
    return tokenized.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(length).alias("n_tokens"),
        (F.sum(length) / F.count(F.lit(1))).alias("avg_tokens"),
    )


def distinct_tokens(tokenized: DataFrame) -> DataFrame:
    """Number of different ids in use. Ids repeat within a row, so each row sends a distinct set."""
    return tokenized.select(F.explode(F.array_distinct("input_ids")).alias("token")).agg(
        F.count_distinct("token").alias("n_distinct_tokens")
    )


def token_sketches(tokenized: DataFrame, keys: list[str], precision: int = 14) -> DataFrame:
    """A sketch of the different ids of each group, ``keys, sketch``: of fixed size, to be stored and merged. With 14 bits the
    number of ids comes out within about 1 %."""
    ids = tokenized.select(*keys, F.explode(F.array_distinct("input_ids")).alias("token"))
    return ids.groupBy(*keys).agg(F.hll_sketch_agg("token", precision).alias("sketch"))


def merged_distinct_tokens(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Estimated number of different ids of all sketches, or of each group of them."""
    merged = sketches.groupBy(*(keys or [])).agg(F.hll_union_agg("sketch").alias("_all"))
    return merged.select(*(keys or []), F.hll_sketch_estimate("_all").alias("n_distinct_tokens"))
