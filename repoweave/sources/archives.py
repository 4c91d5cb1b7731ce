"""Package archives: members as rows instead of files on disk."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.functions.imports import DEFAULT_LANGUAGES, language
from repoweave.functions.text import archive_name, decode_text
from repoweave.session import shared_checkpoint, shared_table

# Largest manifest that is broadcast, and the most different extensions that are handed to the reader.
BROADCAST_ENTRIES = 100_000
MOST_EXTENSIONS = 1_000
_MEMBER = "repo_name string, rel_path string, raw binary, reason string"
_BATCH_BYTES = 16 << 20


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded ``.tar.gz`` files as ``(repo_name, archive, content)``, named after the archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    return files.select(archive_name(F.col("path")).alias("repo_name"), archive_name(F.col("path")).alias("archive"), "content")


def _wanted(name: str, folder: str, suffixes: tuple[str, ...] | None) -> str | None:
    """The path below ``folder`` of a member that is asked for."""
    path = posixpath.normpath(name)
    if not path.startswith(f"{folder}/") or (suffixes is not None and not path.endswith(suffixes)):
        return None
    return path[len(folder) + 1 :]


def _outside(name: str) -> bool:
    return name.startswith("/") or ".." in name.split("/")


def _members(data: bytes, folder: str, suffixes: tuple[str, ...] | None = None) -> Iterator[tuple[str, bytes | None, str | None]]:
    """``(path, bytes, reject reason)`` of the files below ``folder`` with one of ``suffixes``. Members that point outside are
    rejected.

    The archive is streamed twice and never held unpacked: the first pass reads headers, to find the last of several members
    of one name, the second one the members that count. Links need their target, so an archive with a wanted link is read
    with random access.
    """
    last: dict[str, int] = {}
    linked = False
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as archive:
        for i, member in enumerate(archive):
            if _outside(member.name) or _wanted(member.name, folder, suffixes) is not None:
                last[member.name] = i
                linked = linked or member.islnk() or member.issym()
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz" if linked else "r|gz") as archive:
        for i, member in enumerate(archive):
            if last.get(member.name) != i:
                continue
            if _outside(member.name):
                yield member.name, None, "path leaves the archive"
                continue
            if member.isdir():
                continue
            try:
                file = archive.extractfile(member)
            except KeyError:
                file = None
            if file is not None:
                yield _wanted(member.name, folder, suffixes), file.read(), None


def _unpack(suffixes: tuple[str, ...] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo_name", "rel_path", "raw", "reason"]
        for batch in batches:
            rows, held = [], 0
            for repo_name, archive, content in zip(batch["repo_name"], batch["archive"], batch["content"]):
                try:
                    for path, raw, reason in _members(bytes(content), archive, suffixes):
                        rows.append((repo_name, path, raw, reason))
                        held += len(raw or b"")
                        if held >= _BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                except (tarfile.TarError, OSError, EOFError, zlib.error) as problem:
                    rows.append((repo_name, None, None, f"{type(problem).__name__}: {problem}"))
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return run


def archive_members(archives: DataFrame, extensions: Sequence[str] | None = None) -> DataFrame:
    """Members of archives ``(repo_name, archive, content)``: ``(repo_name, rel_path, raw, reason)``, all files or those whose
    name ends in one of ``extensions``; others are not unpacked.

    The archive's top folder, named like the archive, is replaced by the package name; what lies beside it does
    not belong to the package.
    """
    suffixes = None if extensions is None else tuple(extensions)
    return archives.select("repo_name", "archive", "content").mapInPandas(_unpack(suffixes), _MEMBER)


def scan_archives(
    archives: DataFrame, manifest: DataFrame, languages: tuple[str, ...] = DEFAULT_LANGUAGES
) -> tuple[DataFrame, DataFrame]:
    """Files of a manifest ``(repo_ord, repo_name, url, path, extensions)`` from downloaded archives ``(archive, content)``, in
    the columns of a scanned tree, and rejects.

    An entry's archive is named by the last part of its ``url``. Archives that no entry asks for are not unpacked; members are
    unpacked once and staged. Rejects are broken archives, members that point outside, and entries whose archive is missing.
    """
    entries = manifest.filter(F.col("url").isNotNull()).withColumn("archive", archive_name(F.col("url")))
    entries, seen = shared_checkpoint(entries.select("repo_ord", "repo_name", "path", "extensions", "archive"), n=F.count(F.lit(1)))
    small = F.broadcast if seen["n"] <= BROADCAST_ENTRIES else (lambda df: df.hint("shuffle_hash"))
    endings = entries.select(F.explode("extensions").alias("e")).distinct().limit(MOST_EXTENSIONS + 1).collect()
    suffixes = [language(name).suffix for name in languages] + [r["e"] for r in endings]
    asked = archives.join(small(entries.select("archive").distinct()), "archive", "left_semi")
    named = asked.select(F.col("archive").alias("repo_name"), "archive", "content")
    members = shared_table(archive_members(named, suffixes if len(endings) <= MOST_EXTENSIONS else None))
    of_entry = members.withColumnRenamed("repo_name", "archive").join(small(entries), "archive")
    selected = F.exists("extensions", lambda e: F.endswith(F.col("rel_path"), e))
    files = of_entry.filter(F.col("reason").isNull()).select(
        F.col("repo_ord").cast("int").alias("repo_ord"), "repo_name", F.concat_ws("/", "path", "rel_path").alias("file_path"), "rel_path",
        F.length("raw").cast("long").alias("size"), selected.alias("selected"), decode_text(F.col("raw")).alias("content"),
        F.lit(None).cast("string").alias("read_error"),
    )
    broken = of_entry.filter(F.col("reason").isNotNull()).select("repo_name", "rel_path", F.lit("unpack").alias("stage"), "reason")
    missing = entries.join(archives.select("archive"), "archive", "left_anti").select(
        "repo_name", F.lit(None).cast("string").alias("rel_path"), F.lit("download").alias("stage"), F.lit("archive not found").alias("reason")
    )
    return shared_table(files), broken.unionByName(missing)


def archive_files(archives: DataFrame, repos_dir: str = "repos") -> DataFrame:
    """Readable members as corpus files ``(repo_name, rel_path, file_path, content)``."""
    return archive_members(archives).filter(F.col("reason").isNull()).select(
        "repo_name",
        "rel_path",
        F.concat_ws("/", F.lit(repos_dir), "repo_name", "rel_path").alias("file_path"),
        decode_text(F.col("raw")).alias("content"),
    )


def archive_rejects(archives: DataFrame) -> DataFrame:
    return archive_members(archives).filter(F.col("reason").isNotNull()).select(
        "repo_name", "rel_path", F.lit("unpack").alias("stage"), "reason"
    )
