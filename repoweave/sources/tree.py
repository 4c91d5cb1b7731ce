"""Repository trees on a file system that every executor mounts.

Spark's own file sources skip names that begin with ``_`` or ``.``, which would lose ``__init__.py``, so the walk is
a job of its own: tasks list folders, hand folders they did not get to back as rows, and the next round deals those
out again. A huge repository thus spreads over the cluster instead of staying with one task. Reading is a second
step, dealt out by file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.functions.imports import DEFAULT_LANGUAGES, language
from repoweave.functions.text import rel_path
from repoweave.session import shared_checkpoint, shared_table

# Entries one task lists per starting folder before it hands the rest back.
WALK_ENTRIES = 20_000
# Target size of one read task and of one Arrow batch.
READ_TASK_BYTES = 128 << 20
READ_BATCH_BYTES = 16 << 20

_ENTRY = "repo_ord int, repo_name string, root string, extensions array<string>, path string, is_dir boolean, size long"


def _is_folder(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir()
    except OSError:
        return False


def _list_folders(wanted: tuple[str, ...], max_entries: int):
    """Batches of folders to batches of entries: files with a wanted suffix, and folders left for the next round.

    Links to folders are not followed; unreadable folders are passed over.
    """

    def walk(start: str, suffixes: tuple[str, ...]) -> Iterator[tuple[str, bool, int]]:
        waiting, seen = [start], 0
        while waiting and seen < max_entries:
            try:
                with os.scandir(waiting.pop()) as entries:
                    for entry in entries:
                        seen += 1
                        if _is_folder(entry):
                            if not entry.is_symlink():
                                waiting.append(entry.path)
                        elif entry.name.endswith(suffixes):
                            try:
                                size = entry.stat().st_size
                            except OSError:
                                size = 0
                            yield entry.path, False, size
            except OSError:
                continue
        yield from ((folder, True, 0) for folder in waiting)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                suffixes = tuple(row.extensions) + wanted
                chunk = []

                def frame():
                    out = pd.DataFrame(chunk, columns=["path", "is_dir", "size"])
                    return out.assign(
                        repo_ord=row.repo_ord, repo_name=row.repo_name, root=row.root,
                        extensions=[list(row.extensions)] * len(out),
                    )[["repo_ord", "repo_name", "root", "extensions", "path", "is_dir", "size"]]

                for entry in walk(row.path, suffixes):
                    chunk.append(entry)
                    if len(chunk) == 10_000:
                        yield frame()
                        chunk.clear()
                if chunk:
                    yield frame()

    return run


def list_repos(
    manifest: DataFrame, languages: tuple[str, ...] = DEFAULT_LANGUAGES, max_entries: int = WALK_ENTRIES
) -> DataFrame:
    """Files of the manifest's repositories: ``repo_ord, repo_name, file_path, rel_path, size, selected``.

    Besides the extensions of the manifest, source files of ``languages`` are listed, since the import graph covers
    them anyway; ``selected`` tells which files become records.
    """
    spark = manifest.sparkSession
    suffixes = tuple(language(name).suffix for name in languages)
    tasks = max(spark.sparkContext.defaultParallelism * 4, 8)
    frontier = manifest.select(
        F.col("repo_ord").cast("int"), "repo_name", F.rtrim("path", F.lit("/")).alias("root"), "extensions"
    ).withColumn("path", F.col("root"))
    files = None
    while True:
        entries, seen = shared_checkpoint(
            frontier.repartition(tasks, "repo_ord", "path").mapInPandas(_list_folders(suffixes, max_entries), _ENTRY),
            folders=F.count_if("is_dir"),
        )
        found = entries.filter("not is_dir")
        files = found if files is None else files.unionByName(found)
        if seen["folders"] == 0:
            break
        frontier = entries.filter("is_dir").select("repo_ord", "repo_name", "root", "extensions", "path")
    return files.select(
        "repo_ord",
        "repo_name",
        F.col("path").alias("file_path"),
        rel_path(F.col("path"), F.col("root")).alias("rel_path"),
        "size",
        F.exists("extensions", lambda ext: F.endswith(F.col("path"), ext)).alias("selected"),
    )


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the text of each file. A file that cannot be read gives empty text and the reason."""

    def emit(batch, start, texts, errors):
        part = batch.slice(start, len(texts))
        columns = [*part.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "content", "read_error"])

    for batch in batches:
        start, texts, errors, held = 0, [], [], 0
        for path in batch.column("file_path").to_pylist():
            try:
                with open(path, encoding="utf-8", errors="ignore") as file:
                    text, error = file.read(), None
            except OSError as problem:
                text, error = "", f"{type(problem).__name__}: {problem}"
            texts.append(text)
            errors.append(error)
            held += len(text)
            if held >= READ_BATCH_BYTES:
                yield emit(batch, start, texts, errors)
                start, texts, errors, held = start + len(texts), [], [], 0
        if texts:
            yield emit(batch, start, texts, errors)


def read_files(listing: DataFrame) -> DataFrame:
    """Add ``content`` and ``read_error`` to a listing; files are dealt out by a hash of their path."""
    spark = listing.sparkSession
    total = listing.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_TASK_BYTES))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema.fields)
    return listing.repartition(tasks, "file_path").mapInArrow(
        _read_batches, f"{schema}, content string, read_error string"
    )


def scan_repos(
    manifest: DataFrame, languages: tuple[str, ...] = DEFAULT_LANGUAGES, max_entries: int = WALK_ENTRIES
) -> DataFrame:
    """All source files of a manifest ``(repo_ord, repo_name, path, extensions)`` with their text.

    Every file is opened once: the rows are written as a table in the shared folder, from which later steps read names
    without text, or the text in large splits.
    """
    return shared_table(read_files(list_repos(manifest, languages, max_entries)))


def read_rejects(files: DataFrame) -> DataFrame:
    """Rejects: files whose text could not be read."""
    return files.filter(F.col("read_error").isNotNull()).select(
        "repo_name", "rel_path", F.lit("read").alias("stage"), F.col("read_error").alias("reason")
    )
