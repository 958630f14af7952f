"""Ranks in long groups, and joins on keys that may hold a third of all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.functions import sizing
from docloom.llm import base

#: A key with more than one row in so many of all rows is hot; there can be no more such keys than this.
HOT_SHARE = 1024


def told_apart(value: Column) -> Column:
    """The value as a string that is never null: nulls come first and equal only each other."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _numbered(batches):
    """Rows before each row in its run of equal ``_g``, within the partition."""
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g, at = batch.column("_g"), np.arange(n)
        begins = np.ones(n, dtype=bool)
        begins[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begins[0] = g[0].as_py() != last
        start = np.maximum.accumulate(np.where(begins, at, -1))
        rank = np.where(start < 0, at + seen, at - start)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64())], names=[*batch.schema.names, "_rank"])
        last, seen = g[n - 1].as_py(), int(rank[-1]) + 1


def ranked(df: DataFrame, order: list, label: str) -> DataFrame:
    """``df``, stored, with ``_rank``: 0, 1, ... within the rows of equal ``_g``, in ``order``.

    ``_g`` is a string without nulls. One range shuffle; a group may lie in many partitions, and rows
    that ``order`` does not tell apart are dealt too, so no group is sorted in one task. Only the
    first and the last group of a partition can lie in another one as well: their counts, two rows a
    partition, are summed once more and added back.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(n, "_g", *order, "_spread")
             .sortWithinPartitions("_g", *order, "_spread").drop("_spread").withColumn("_part", F.spark_partition_id()))
    local = base.stored(dealt.mapInArrow(_numbered, StructType([*dealt.schema, StructField("_rank", LongType())])), label)
    ends = local.groupBy("_part").agg(F.min(F.struct("_g", (-F.col("_rank")).alias("r"))).alias("lo"), F.max(F.struct("_g", "_rank")).alias("hi"))
    pieces = ends.select("_part", F.explode(F.array_distinct(F.array(
        F.struct(F.col("lo._g").alias("_g"), (1 - F.col("lo.r")).alias("rows")),
        F.struct(F.col("hi._g").alias("_g"), (F.col("hi._rank") + 1).alias("rows"))))).alias("p")).select("_part", "p.*")
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("_part", "_g", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_before"))  # two rows a partition
    return local.join(F.broadcast(before), ["_part", "_g"], "left").withColumn(
        "_rank", F.col("_rank") + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def look_up(rows: DataFrame, lookup: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has one row per key and the key's number of rows in ``count``.

    Hot keys, at most ``HOT_SHARE`` of them, go out to the rows; the others meet in a shuffle in
    which no key holds more than one row in ``HOT_SHARE``.
    """
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(lookup.where(is_hot))
    cold = rows.join(F.broadcast(lookup.where(is_hot).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(lookup.where(~is_hot), on))


def small_or_not(df: DataFrame, narrow_rows: int = sizing.SMALL_ROWS) -> DataFrame:
    """``df``, of a few short columns, with a broadcast hint if it was counted and is small."""
    return sizing.small_side(df, sizing.is_small(df, narrow_rows))
