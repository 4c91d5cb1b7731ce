"""Token rows as Parquet with their place in the flat stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from repoweave.operators.tokens import place_tokens


def write_tokens(
    tokenized: DataFrame, path: str, order_by: Sequence[str], mode: str = "errorifexists"
) -> None:
    """Write ``input_ids`` with ``offset`` and ``n_tokens``, range-sorted by offset.

    Read in file order, the arrays joined end to end are the flat training buffer.
    """
    placed = place_tokens(tokenized, order_by)
    placed.repartitionByRange("offset").sortWithinPartitions("offset").write.mode(mode).parquet(path)
