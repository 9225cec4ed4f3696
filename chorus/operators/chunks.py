"""Row numbers and chunk numbers within groups, without a task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, group: Sequence[str], order: str = "ord", width: int = 10_000,
                name: str = "row_number") -> DataFrame:
    """1-based row number within ``group`` by the whole-number column ``order`` (unique within a group).

    A slice is a fixed range of ``order`` (``order div width``), a value of the row itself: however rows are dealt
    to tasks, a row's slice is the same wherever it is computed.  Rows are numbered within (group, slice), of at
    most ``width`` rows, and the rows of the group's earlier slices are added.  Sums of slices are
    themselves taken in two levels (slices of slices), so no window holds a large group's slices at once.
    NULL groups are groups of their own; rows with a NULL order come first, as one slice.
    """
    group = list(group)
    low = F.floor(F.col(order) / F.lit(width))
    rows = df.withColumns({"_slice": low, "_block": F.floor(low / F.lit(width))})
    counts = rows.groupBy(*group, "_block", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    blocks = counts.groupBy(*group, "_block").agg(F.sum("_n").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.sum("_n").over(
        Window.partitionBy(*group).orderBy("_block").rowsBetween(*before))).drop("_n")
    slices = counts.withColumn("_inner", F.sum("_n").over(
        Window.partitionBy(*group, "_block").orderBy("_slice").rowsBetween(*before))).drop("_n")

    def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
        on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
        return left.join(r, on).drop(*[f"_r_{k}" for k in keys])

    starts = matched(slices, blocks, [*group, "_block"]).select(
        *group, "_slice", (F.coalesce("_base", F.lit(0)) + F.coalesce("_inner", F.lit(0))).alias("_before"))
    local = rows.drop("_block").withColumn(
        "_local", F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(order)))
    out = matched(local, starts, [*group, "_slice"])
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_slice", "_local", "_before")


def chunk_numbers(df: DataFrame, group: Sequence[str], size: int, order: str = "ord") -> DataFrame:
    """``chunk = (row number within group - 1) // size``."""
    numbered = row_numbers(df, group, order, name="_number")
    return numbered.withColumn("chunk", F.floor((F.col("_number") - 1) / F.lit(size)).cast("long")).drop("_number")
