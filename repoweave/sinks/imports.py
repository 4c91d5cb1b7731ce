"""A store of import sets that grows with each run.

Entries ``(path_key, modules)`` are filed by a hash of the key and only ever appended. Two runs at a time may both add a file;
of equal keys one entry counts. ``compact_imports`` writes a store anew with one entry per key and few files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.functions.imports import DEFAULT_LANGUAGES
from repoweave.operators.dependencies import incremental_imports
from repoweave.session import shared_table

BUCKETS = 64
ENTRY = "path_key string, modules array<string>"


def save_imports(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Add ``path_key, modules`` to a store. A bucket with many new entries is split among tasks."""
    bucket = F.pmod(F.xxhash64("path_key"), F.lit(BUCKETS)).cast("int")
    filed = entries.select("path_key", "modules", bucket.alias("bucket")).hint("rebalance", "bucket")
    filed.write.mode(mode).partitionBy("bucket").parquet(path)


def load_imports(spark: SparkSession, path: str) -> DataFrame:
    """One entry per key; none where nothing was stored yet."""
    try:
        stored = spark.read.schema(f"{ENTRY}, bucket int").parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)
    return stored.groupBy("bucket", "path_key").agg(F.min("modules").alias("modules")).drop("bucket")


def compact_imports(spark: SparkSession, path: str, target: str) -> None:
    """Write the entries of a store to a new one, each key once."""
    save_imports(load_imports(spark, path), target, mode="errorifexists")


def stored_imports(files: DataFrame, path: str, languages: Sequence[str] = DEFAULT_LANGUAGES) -> DataFrame:
    """Import sets of ``files`` as ``incremental_imports`` gives them; what was not in the store is parsed once and added."""
    found = shared_table(incremental_imports(files, load_imports(files.sparkSession, path), languages))
    save_imports(found.filter("not from_cache"), path)
    return found
