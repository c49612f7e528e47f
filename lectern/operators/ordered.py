"""Ordered running values inside groups of any size.

A window over a whole group puts the group into one task. The functions here cut every group into
blocks that follow the sort order, work inside the blocks, and carry one small row per block from
block to block; only those small rows are ordered over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def block_of(order: Column, span: int = BLOCK_ROWS) -> Column:
    """Block number of a numeric sort value; larger values never get a smaller number."""
    return F.floor(order / F.lit(span)).cast("bigint")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Add the total of ``value`` over all earlier rows of the group, the row itself left out.

    ``order`` has to identify a row inside its group; ``block`` has to follow that order.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    before = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .select(
            *keys,
            "_block",
            F.coalesce(
                F.sum("_total").over(
                    Window.partitionBy(*keys)
                    .orderBy("_block")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_carried"),
        )
    )
    inside = F.coalesce(
        F.sum("_value").over(
            Window.partitionBy(*keys, "_block")
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    return (
        blocked.withColumn("_inside", inside)
        .join(before, [*keys, "_block"])
        .withColumn(out, F.col("_carried") + F.col("_inside"))
        .drop("_block", "_value", "_inside", "_carried")
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Add ``value`` of the row before in the group; null on the first row of the group."""
    keys = list(keys)
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    last = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max_by("_value", F.struct(*order)).alias("_last"))
        .select(
            *keys,
            "_block",
            F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carried"),
        )
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        blocked.withColumn("_rank", F.row_number().over(inside))
        .withColumn("_inside", F.lag("_value").over(inside))
        .join(last, [*keys, "_block"])
        .withColumn(out, F.when(F.col("_rank") == 1, F.col("_carried")).otherwise(F.col("_inside")))
        .drop("_block", "_value", "_rank", "_inside", "_carried")
    )
