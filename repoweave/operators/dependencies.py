"""From files to the import graph: statements, module lookup, edges.

``files`` has one row per ``(repo_name, rel_path)`` and carries ``content``. Everything behind
``extract_imports`` works on names only, so file text is read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoweave.functions.imports import DEFAULT_LANGUAGES, Language, language
from repoweave.functions.text import file_name, folder_of
from repoweave.operators.joins import attach, salted_join
from repoweave.session import shared_checkpoint


def _by_suffix(languages: Sequence[Language], path: Column, pick) -> Column:
    """``pick(language)`` for the language whose suffix the path has; null otherwise."""
    branches = [(path.endswith(entry.suffix), pick(entry)) for entry in languages]
    first = F.when(*branches[0])
    return reduce(lambda expr, branch: expr.when(*branch), branches[1:], first)


def _source_filter(languages: Sequence[Language], path: Column) -> Column:
    return reduce(lambda a, b: a | b, [path.endswith(entry.suffix) for entry in languages])


def source_files(files: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES) -> DataFrame:
    """Files of the given languages by suffix, whatever extensions the manifest asks for."""
    entries = [language(name) for name in languages]
    path = F.col("rel_path")
    return files.filter(_source_filter(entries, path)).withColumn(
        "source_language", _by_suffix(entries, path, lambda entry: F.lit(entry.name))
    )


def import_sets(
    files: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES, keep: Sequence[str] = ()
) -> DataFrame:
    """``(repo_name, rel_path, source_language, *keep, modules)``: one distinct module array per source file."""
    entries = [language(name) for name in languages]

    def modules(entry: Language) -> Column:
        found = F.array_distinct(entry.modules(F.col("content")))
        if entry.ignored:
            found = F.array_except(found, F.array(*[F.lit(m) for m in entry.ignored]))
        return found

    return source_files(files, languages).select(
        "repo_name",
        "rel_path",
        "source_language",
        *keep,
        _by_suffix(entries, F.col("rel_path"), modules).alias("modules"),
    )


def extract_imports(files: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES) -> DataFrame:
    """Distinct ``(repo_name, rel_path, source_language, module)``. One scan for all languages, no shuffle:
    a file's modules are made distinct inside its row.

    The outer form keeps the optimizer from testing the array below the generator, which would match the patterns anew.
    """
    found = import_sets(files, languages).select(
        "repo_name", "rel_path", "source_language", F.explode_outer("modules").alias("module")
    )
    return found.filter(F.col("module").isNotNull())


def module_index(paths: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES) -> DataFrame:
    """For each source file name of a repository, the first file of that name in sorted walk order.

    A folder comes before its subfolders, siblings by name. The minimum is combined map-side, so a name
    that occurs in every folder (``__init__.py``) does not pile up in one task.
    """
    first = F.min(F.struct(F.split(folder_of(F.col("rel_path")), "/").alias("folder"), F.col("rel_path")))
    return (
        paths.filter(_source_filter([language(name) for name in languages], F.col("rel_path")))
        .groupBy("repo_name", file_name(F.col("rel_path")).alias("file_name"))
        .agg(first.alias("first"))
        .select("repo_name", "file_name", F.col("first.rel_path").alias("target"))
    )


def resolve_imports(
    imports: DataFrame, paths: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES, rows: int | None = None
) -> DataFrame:
    """Join imports to the files they name; imports without a file drop out.

    A module resolves when ``module + suffix`` is the base name of a file. A dotted module would have to match a
    name with a slash in it, so it never does and is left out before the shuffle. ``rows`` is the number of
    imports, when known.
    """
    entries = [language(name) for name in languages]
    suffix = reduce(
        lambda expr, entry: expr.when(F.col("source_language") == entry.name, F.lit(entry.suffix)),
        entries[1:],
        F.when(F.col("source_language") == entries[0].name, F.lit(entries[0].suffix)),
    )
    wanted = imports.filter(~F.contains("module", F.lit("."))).withColumn(
        "file_name", F.concat(F.col("module"), suffix)
    )
    return salted_join(
        wanted, module_index(paths, languages), ["repo_name", "file_name"], spread_by=["rel_path"], rows=rows
    ).select("repo_name", "source_language", "rel_path", "module", "target")


def edges_of(
    imports: DataFrame, paths: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES, rows: int | None = None
) -> DataFrame:
    """``(repo_name, src, dst)``, importer to imported, self-loops included.

    No ``distinct``: a file's modules are distinct, each names one base name, and each base name one file.
    """
    return resolve_imports(imports, paths, languages, rows).select(
        "repo_name", F.col("rel_path").alias("src"), F.col("target").alias("dst")
    )


def dependency_edges(files: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES) -> DataFrame:
    """Import graph of every repository at once.

    The extracted names are checkpointed: the lookup reads them twice (hot-name count and join), the text once.
    """
    imports, seen = shared_checkpoint(extract_imports(files, languages), rows=F.count(F.lit(1)))
    return edges_of(imports, files.select("repo_name", "rel_path"), languages, seen["rows"])


def graph_nodes(paths: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES) -> DataFrame:
    """Every source file is a node, with or without edges."""
    return source_files(paths, languages).select("repo_name", "rel_path")


def compose_graphs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two node or edge sets of the same schema."""
    return first.unionByName(second).distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def path_key(file_path: Column) -> Column:
    """Cache key of a file."""
    return F.sha2(file_path, 256)


def incremental_imports(
    files: DataFrame, cached: DataFrame, languages: Sequence[str] = DEFAULT_LANGUAGES
) -> DataFrame:
    """Import sets with a cache ``(path_key, modules)`` in front: only files without an entry are parsed.

    A hit is taken as it is, even when the file has changed since. Returns
    ``(repo_name, rel_path, source_language, path_key, modules, from_cache)``; the misses are the rows to append.
    """
    keyed = files.withColumn("path_key", path_key(F.col("file_path")))
    known = cached.select("path_key", "modules")
    hits = (
        source_files(keyed, languages)
        .select("repo_name", "rel_path", "source_language", "path_key")
        .join(known, "path_key")
        .withColumn("from_cache", F.lit(True))
    )
    misses = attach(keyed, known.select("path_key"), ["path_key"], "left_anti")
    parsed = import_sets(misses, languages, keep=["path_key"]).withColumn("from_cache", F.lit(False))
    return hits.unionByName(parsed)
