"""Joins shaped for wide rows and for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over several tasks.
HOT_KEY_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_KEY_ROWS) -> DataFrame:
    """Keys above ``limit`` rows with the number of slices each needs. Holds at most rows/limit keys."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > limit).select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_slices"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    limit: int = HOT_KEY_ROWS,
    hot: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Equi join for a ``right`` side that is unique on ``keys``.

    Left rows of a hot key are dealt out by a hash of ``spread_by``; the one right row of that key is repeated
    once per slice. All other rows join as usual. The list of hot keys is broadcast: it has at most
    rows/limit entries, one per million left rows by default. When ``rows`` (known size of the left side) is
    within the limit, no key can be hot and the join is a plain one.
    """
    if rows is not None and rows <= limit:
        return left.join(right, keys, how)
    if hot is None:
        hot = hot_keys(left, keys, limit)
    hot = F.broadcast(hot)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    dealt = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), slices).cast("int"))
        .drop("_slices")
    )
    repeated = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - F.lit(1))))
        .drop("_slices")
    )
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def attach(wide: DataFrame, narrow: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a few columns to rows that carry text or tokens, on a key that is unique in ``narrow``.

    The hash join builds on the narrow side, so wide rows are shuffled but not sorted.
    """
    return wide.join(narrow.hint("shuffle_hash"), keys, how)
