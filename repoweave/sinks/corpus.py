"""Finished corpora as JSON Lines, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.functions.records import RECORD_SCHEMA, truncate_record
from repoweave.plans.corpus import CORPUS_ORDER


def write_corpus(
    records: DataFrame,
    path: str,
    order_by: Sequence[str] = CORPUS_ORDER,
    mode: str = "errorifexists",
    partitions: int | None = None,
) -> None:
    """Write records as JSON Lines in the order of ``order_by``: by file name, then by line.

    The range sort is the only shuffle of the text. An existing target is refused unless ``mode="overwrite"``.
    """
    ranged = records.repartitionByRange(*filter(None, [partitions]), *order_by)
    write_jsonl(ranged.sortWithinPartitions(*order_by).select(*RECORD_SCHEMA.fieldNames()), path, mode)


def write_jsonl(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line in the present order; null fields are written out."""
    records.write.mode(mode).option("ignoreNullFields", False).json(path)


def to_jsonl(
    records: DataFrame, path: str, length: int, keep_terminator: bool = False, mode: str = "errorifexists"
) -> None:
    """Cut every record's content to ``length`` characters and write JSON Lines. No shuffle."""
    cut = truncate_record(F.col("content"), length, keep_terminator)
    write_jsonl(records.withColumn("content", cut), path, mode)
