"""Exact order statistics of long groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import sizing
from docloom.session import cut_lineage

def cumulated(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``(*group, v, c, upto)``: every distinct value of a group, how often it occurs, and how many rows are not above it.

    Equal values are one row with a count from the start, so a value that most of a group shares
    weighs nothing. Distinct values are dealt by measured ranges of (group, value): a long group lies in many tasks,
    each of which sums up its own part; the parts' totals, one row per group and task, are summed once more.
    Null and NaN values are left out.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    dealt = cut_lineage(counted.repartitionByRange(n, *group, "v").withColumn("_part", F.spark_partition_id()), "values")
    totals = dealt.groupBy(*group, "_part").agg(F.sum("c").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*group, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = F.sum("c").over(Window.partitionBy(*group, "_part").orderBy("v"))
    return dealt.join(before, [*group, "_part"]).select(*group, "v", "c", (local + F.col("_before")).alias("upto"))


def at_indexes(df: DataFrame, group: Sequence[str], value: str, indexes: DataFrame) -> DataFrame:
    """``(*group, index, value)``: the value at each 0-based index of its group's sorted values, nulls and NaN aside.

    ``indexes(*group, index)`` are few per group; an index beyond the group's rows finds nothing.
    """
    wanted = indexes.select(*group, F.col("index").cast("long").alias("index")).distinct()
    held = cumulated(df, group, value).join(sizing.small_side(wanted, sizing.is_small(wanted)), list(group))
    return held.where((F.col("upto") > F.col("index")) & (F.col("upto") - F.col("c") <= F.col("index"))).select(*group, "index", F.col("v").alias("value"))


def quantiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``(*group, *shares)``: interpolated quantiles of each group, null values left out."""
    n = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("_n"))
    place = lambda share: (F.col("_n") - 1) * F.lit(share)
    wanted = n.select(*group, F.explode(F.array(*[f(place(s)).cast("long") for s in shares.values() for f in (F.floor, F.ceil)])).alias("index")).distinct()
    found = at_indexes(df, group, value, wanted).groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("index", F.col("value").cast("double")))).alias("_at"))

    def between(share: float) -> Column:
        lo, hi = F.floor(place(share)).cast("long"), F.ceil(place(share)).cast("long")
        a, b = F.element_at("_at", lo), F.element_at("_at", hi)
        return a + (b - a) * (place(share) - lo)

    return n.join(found, list(group)).select(*group, *[between(s).alias(name) for name, s in shares.items()])
