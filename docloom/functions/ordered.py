"""Ordered-group helpers that stay parallel when one group holds much of the data.

A plain window sorts a whole group in one task. These helpers take a *slice* column that
cuts a group into ordered pieces (a day, an hour, an id range): the window runs per
(group, slice), one row per slice is summarised, and the small summary carries what one
slice needs from the slices before it. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced_row_number(
    df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[str], name: str = "rn"
) -> DataFrame:
    """1-based position in the group, with slices ordered by ``slice_col`` and rows by ``order``."""
    keys = [*group, slice_col]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (
        local.join(offsets, keys)
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("long"))
        .drop("_rn", "_before")
    )


def sliced_lag(
    df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """The ``value`` of the row before, looking into earlier slices where a slice begins."""
    keys = [*group, slice_col]
    local = Window.partitionBy(*keys).orderBy(*order)
    with_value = df.withColumn("_v", value)
    last = with_value.groupBy(*keys).agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    carried = last.select(*keys, F.lag("_last").over(Window.partitionBy(*group).orderBy(slice_col)).alias("_carry"))
    return (
        with_value.withColumn("_prev", F.lag("_v").over(local))
        .withColumn("_first", F.row_number().over(local) == 1)
        .join(carried, keys)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_v", "_prev", "_first", "_carry")
    )


def order_statistic(df: DataFrame, group: Sequence[str], value: str, index: Column, width: float = 0.001, name: str = "picked") -> DataFrame:
    """The value at a 0-based ``index`` of each group's sorted values, without sorting whole groups.

    Values are counted per ``width``-wide slice; only the slice that holds the index is sorted.
    ``index`` may use the group's row count as column ``n``.
    """
    sliced = df.where(F.col(value).isNotNull()).withColumn("_slice", F.floor(F.col(value) / F.lit(width)))
    counts = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    located = (
        counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        .withColumn("n", F.sum("_c").over(everything)).withColumn("_i", F.least(index, F.col("n") - 1))
        .where((F.col("_before") <= F.col("_i")) & (F.col("_i") < F.col("_before") + F.col("_c")))
    )
    inside = sliced.join(located, [*group, "_slice"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*group).orderBy(value)) + F.col("_before") - 1)
    return inside.where(F.col("_rn") == F.col("_i")).select(*group, "n", F.col(value).alias(name))
