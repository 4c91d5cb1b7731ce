"""The corpus record: context prefix, end marker, and reproducible randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers that downstream tokenizers expect verbatim.
REPO_MARK = "<repo_name>"
FILE_MARK = "<file_sep>"
END_MARK = "<|endoftext|>"

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("repo_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)


def _draw(purpose: str, seed: int, key: Column) -> Column:
    """A hash of the row's key: the same on every run, whatever the partitioning.

    ``purpose`` keeps the draws apart. With one hash for both, a shuffle would put every prefixed file first.
    """
    return F.md5(F.concat(F.lit(f"{purpose}:{seed}:"), key))


def shuffle_key(seed: int, key: Column) -> Column:
    return _draw("order", seed, key)


def coin(seed: int, key: Column) -> Column:
    """True for half of the keys."""
    return F.substring(_draw("context", seed, key), 1, 1) <= F.lit("7")


def format_context(repo_name: Column, file_path: Column, content: Column, seed: int) -> Column:
    """Content with its end marker; every other file (by coin) also names its repository and path."""
    named = F.concat(F.lit(REPO_MARK), repo_name, F.lit(FILE_MARK), file_path, F.lit("\n"), content, F.lit(END_MARK))
    return F.when(coin(seed, file_path), named).otherwise(F.concat(content, F.lit(END_MARK)))


def truncate_record(content: Column, length: int, keep_terminator: bool = False) -> Column:
    """Cut a finished record to ``length`` characters; a cut record loses its end marker unless told to keep it."""
    from repoweave.functions.text import truncate_content

    cut = truncate_content(content, length)
    if not keep_terminator:
        return cut
    room = max(length - len(END_MARK), 0)
    return F.when(F.length(content) <= F.lit(length), content).otherwise(
        F.concat(truncate_content(content, room), F.lit(END_MARK))
    )
