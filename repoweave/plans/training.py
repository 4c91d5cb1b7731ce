"""From a finished corpus to fixed-length training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from repoweave.operators.tokens import END_ID, Encoder, tokenize, training_rows

# Fixed value: row length of the training configuration.
ROW_LENGTH = 1024


def training_table(
    records: DataFrame, create: Callable[[], Encoder], length: int = ROW_LENGTH, pad: int = END_ID
) -> DataFrame:
    """Records with ``content`` replaced by ``input_ids``, ``attention_mask`` and ``labels``. No shuffle."""
    return training_rows(tokenize(records, create), length, pad)
