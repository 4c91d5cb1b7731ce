"""Path and text expressions; all of them stay in the JVM except the lenient decoder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INT = 2**31 - 1


def language_of(path: Column) -> Column:
    """Text after the last dot of the path; the whole path when it has none."""
    return F.substring_index(path, ".", -1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    """Folder part of a relative path, empty for files in the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/", 1)).otherwise(F.lit(""))


def rel_path(file_path: Column, root: Column) -> Column:
    return F.substring(file_path, F.length(root) + F.lit(2), F.lit(MAX_INT))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def has_extension(path: Column, extensions: Column) -> Column:
    """True when the path ends with any entry of an array column."""
    return F.exists(extensions, lambda ext: F.endswith(path, ext))


def truncate_content(content: Column, length: int) -> Column:
    """First ``length`` characters (code points). Spark's length is an INT, hence the clamp."""
    return F.substring(content, 1, min(length, MAX_INT))


def archive_name(url: Column) -> Column:
    """Last part of a download link without the archive suffix."""
    return F.substring_index(F.substring_index(url, "/", -1), ".tar.gz", 1)


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


@F.pandas_udf(T.StringType())
def _drop_invalid_bytes(raw: pd.Series) -> pd.Series:
    return raw.map(lambda data: None if data is None else bytes(data).decode("utf-8", "ignore"))


def decode_text(raw: Column) -> Column:
    """UTF-8 text of a binary column, invalid bytes dropped, line ends made ``\\n``.

    Valid rows are reinterpreted in the JVM; only the bytes of invalid rows travel to a Python worker.
    """
    as_text = raw.cast("string")
    valid = F.is_valid_utf8(as_text)
    repaired = _drop_invalid_bytes(F.when(~valid, raw))
    return unix_newlines(F.when(valid, as_text).otherwise(repaired))
