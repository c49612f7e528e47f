"""Joins that hold when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
MAX_LOOKUP_ROWS = 100_000


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    slice_rows: int = SLICE_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that cuts hot keys of ``big`` into slices of about ``slice_rows`` rows.

    Hot keys are counted first (key columns only, combined before the shuffle). Their rows are
    dealt over slices by a hash of ``spread_by`` and the matching rows of ``small`` are repeated
    once per slice; all other keys join as they are. A key is hot with more rows than ``slice_rows``
    and than one part in MAX_HOT_KEYS of all rows: there cannot be more such keys than that, so their
    list is complete and can be broadcast. Which keys are on it changes the speed, never the result.
    Rows per key that are known already can be given as ``counts`` (the key columns and ``_rows``).
    """
    on = list(on)
    counts = big.groupBy(*on).agg(F.count("*").alias("_rows")) if counts is None else counts
    total = counts.agg((F.sum("_rows") / MAX_HOT_KEYS).alias("_least"))
    least = F.greatest(F.lit(float(slice_rows)), "_least")
    hot = (
        counts.where(F.col("_rows") > slice_rows)
        .crossJoin(F.broadcast(total))
        .where(F.col("_rows") > least)
        .select(*on, F.ceil(F.col("_rows") / least).cast("int").alias("_slices"))
    )
    slices = F.coalesce("_slices", F.lit(1))
    dealt = (
        big.join(F.broadcast(hot), on, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread_by), slices).cast("int"))
        .drop("_slices")
    )
    repeated = (
        small.join(F.broadcast(hot), on, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return dealt.join(repeated, [*on, "_slice"], how).drop("_slice")


def is_small(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> bool:
    """Whether the table has at most ``max_rows`` rows; counting stops right after that."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    max_rows: int = MAX_LOOKUP_ROWS,
) -> DataFrame:
    """Join a large table with a lookup table: broadcast it if its size was checked, else spread."""
    if is_small(small, max_rows):
        return big.join(F.broadcast(small), list(on), how)
    return spread_join(big, small, on, spread_by, how)
