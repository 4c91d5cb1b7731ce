"""Dense positions and running totals without a single-task window.

A plain ``row_number().over(partitionBy(repo))`` sends a whole repository to one task, and without a partition
key the whole table. Here the rows are range-sorted into slices of even size, each slice is numbered by itself,
and the totals of the earlier slices of the same group are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoweave.session import shared_checkpoint


def sort_column(name: str) -> Column:
    return F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc()


def running_total(
    df: DataFrame, value: Column, order_by: Sequence[str], group_by: Sequence[str] = (), name: str = "running_total"
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the group (exclusive).

    ``order_by`` lists column names, ``-name`` for descending; together they must be unique within a group for a
    reproducible result. Keep ``df`` narrow: it is range-sorted and checkpointed once, because the slice of a row
    has to be the same in both passes.
    """
    columns = df.columns
    order = [sort_column(c) for c in order_by]
    ranges = [F.col(c) for c in group_by] + order
    sliced = shared_checkpoint(
        df.withColumn("_value", value.cast("long"))
        .repartitionByRange(*ranges)
        .withColumn("_slice", F.spark_partition_id())
    )

    # One row per slice and group. Only the group that opens a slice can have rows in earlier slices, so at most
    # one row per slice survives the filter: the broadcast is bounded by the number of shuffle partitions.
    per_slice = sliced.groupBy(*group_by, "_slice").agg(F.sum("_value").alias("_slice_total"))
    earlier_slices = Window.partitionBy(*group_by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *group_by, "_slice", F.sum("_slice_total").over(earlier_slices).alias("_carried")
    ).filter(F.col("_carried") > 0)
    within_slice = (
        Window.partitionBy(*group_by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    return (
        sliced.withColumn("_local", F.coalesce(F.sum("_value").over(within_slice), zero))
        .join(F.broadcast(carried), [*group_by, "_slice"], "left")
        .select(*columns, (F.col("_local") + F.coalesce(F.col("_carried"), zero)).alias(name))
    )


def number_rows(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Dense zero-based position of each row in its group."""
    return running_total(df, F.lit(1), order_by, group_by, name)
