"""From files to ordered records: the three corpus settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions.imports import DEFAULT_LANGUAGES
from repoweave.functions.records import format_context, shuffle_key
from repoweave.functions.text import language_of
from repoweave.operators.dependencies import dependency_edges, graph_nodes
from repoweave.operators.graph import LOCAL_EDGES, topo_levels
from repoweave.operators.numbering import number_rows
from repoweave.operators.ordering import dependency_rank, walk_key
from repoweave.operators.joins import attach, salted_join
from repoweave.session import shared_checkpoint
from repoweave.sinks.graph import load_graph, save_graph

GLOBAL_SHUFFLE = 1
IN_REPO_SHUFFLE = 2
DEPENDENCY_ORDER = 3


def records_of(files: DataFrame, seed: int) -> DataFrame:
    """Finished records; all other columns of ``files`` stay."""
    return files.withColumns(
        {
            "language": language_of(F.col("file_path")),
            "content": format_context(F.col("repo_name"), F.col("file_path"), F.col("content"), seed),
        }
    )


# Largest number of stored repositories whose names are broadcast.
BROADCAST_REPOS = 100_000

# Sort columns of a corpus: place of the repository, then of the file in it.
CORPUS_ORDER = ["order_group", "order_key"]


def _key(rank: Column, tie: Column) -> Column:
    return F.struct(rank.cast("long").alias("rank"), tie.alias("tie"))


def corpus(
    files: DataFrame,
    setting: int,
    seed: int = 0,
    order: str = "dependency",
    languages: Sequence[str] = DEFAULT_LANGUAGES,
    local_edges: int = LOCAL_EDGES,
    graph: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Records ``repo_ord, repo_name, rel_path, file_path, language, content`` and sort columns.

    ``files`` has ``repo_ord, repo_name, rel_path, file_path, content``, one row per file, and optionally
    ``selected``; files that are not selected take part in the import graph only. ``order_group, order_key`` sort the
    corpus: setting 1 shuffles everything, setting 2 shuffles within each repository, setting 3 puts imported files before
    their importers. ``order="walk"`` leaves setting 3 in directory order. ``graph`` is a stored ``(nodes, edges)`` pair to use instead of building one.
    """
    if setting not in (GLOBAL_SHUFFLE, IN_REPO_SHUFFLE, DEPENDENCY_ORDER):
        raise ValueError(f"unknown setting {setting}")
    if order not in ("dependency", "walk"):
        raise ValueError(f"unknown order {order!r}")
    wanted = files.filter("selected") if "selected" in files.columns else files
    draw = shuffle_key(seed, F.col("file_path"))
    zero = F.lit(0)

    def shaped(df: DataFrame, key: Column) -> DataFrame:
        group = zero if setting == GLOBAL_SHUFFLE else F.col("repo_ord")
        keyed = df.withColumns({"order_group": group.cast("long"), "order_key": key})
        return records_of(keyed, seed).select(
            "repo_ord", "repo_name", "rel_path", "file_path", "language", "content", *CORPUS_ORDER
        )

    shuffled = _key(zero, F.concat_ws(":", draw, "file_path"))
    if setting in (GLOBAL_SHUFFLE, IN_REPO_SHUFFLE):
        return shaped(wanted, shuffled)
    if order == "walk":
        walk = walk_key(F.col("rel_path"))
        # Joined with the smallest character, folder parts compare as the array of parts does.
        parts = F.concat_ws("\x01", F.array_join(walk["folder"], "\x01"), F.lit(""), walk["name"])
        return shaped(wanted, _key(zero, parts))

    # A graph made here goes by manifest entry, as two entries may have one name; a stored one goes by name.
    repo = F.col("repo_name") if graph else F.col("repo_ord").cast("string")
    if graph:
        nodes, edges = graph
    else:
        own = files.withColumn("repo_name", repo)
        nodes, edges = graph_nodes(own.select("repo_name", "rel_path"), languages), dependency_edges(own, languages)
    levels = shared_checkpoint(topo_levels(nodes, edges, local_edges))
    # Names only up to here: the text is joined once, on a key that is unique per file.
    levels = levels.withColumnRenamed("repo_name", "_repo")
    placed = attach(wanted.withColumn("_repo", repo), levels, ["_repo", "rel_path"], "left")
    return shaped(placed, _key(dependency_rank(F.col("level")), F.col("rel_path")))


def stored_or_built_graph(
    files: DataFrame, path: str, languages: Sequence[str] = DEFAULT_LANGUAGES
) -> tuple[DataFrame, DataFrame]:
    """Import graphs from a store, built and added there for repositories it does not have yet.

    A stored graph is taken as it is, even when files have changed since.
    """
    spark = files.sparkSession
    try:
        stored = load_graph(spark, path)[0].select("repo_name").distinct()
        known, seen = shared_checkpoint(stored, n=F.count(F.lit(1)))
        if seen["n"] <= BROADCAST_REPOS:
            files = files.join(F.broadcast(known), "repo_name", "left_anti")
        else:
            paths = files.select("repo_name", "rel_path")
            fresh = salted_join(paths, known, ["repo_name"], ["rel_path"], how="left_anti")
            files = attach(files, fresh, ["repo_name", "rel_path"], "left_semi")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    save_graph(graph_nodes(files.select("repo_name", "rel_path"), languages), dependency_edges(files, languages), path)
    return load_graph(spark, path)


def with_positions(records: DataFrame, setting: int) -> DataFrame:
    """Add the dense position ``pos``: over the whole corpus for setting 1, else within each repository.

    Numbers the narrow keys, then joins them back on the file.
    """
    group = [] if setting == GLOBAL_SHUFFLE else ["repo_ord", "repo_name"]
    file = ["repo_ord", "repo_name", "file_path"]
    numbered = number_rows(records.select(*file, *CORPUS_ORDER), CORPUS_ORDER, group_by=group).drop(*CORPUS_ORDER)
    return attach(records, numbered, file)
