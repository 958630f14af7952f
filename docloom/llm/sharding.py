"""Contiguous shards of nearly equal bytes from global prefix sums of sizes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm import base


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8; null counts as no text."""
    return (F.octet_length(base.whole(text)) + F.lit(8)).cast("long")


def _running(batches):
    """Sums and row numbers before each row, within the partition."""
    total = rows = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        after = size.cumsum() + total
        n = batch.num_rows
        yield pa.RecordBatch.from_pydict({
            **{name: batch.column(name) for name in batch.schema.names},
            "before": pa.array(after - size, pa.int64()), "row": pa.array(range(rows, rows + n), pa.int64())})
        total, rows = int(after[-1]) if n else total, rows + n


def prefix_sums(df: DataFrame, order: list[str], size: Column, partitions: int | None = None) -> DataFrame:
    """``df`` in global ``order`` with ``size``, ``before`` (sizes of all rows before) and ``row`` (rows before).

    One range shuffle. Each partition sums its own rows; the partitions' totals, one row each, are
    summed once more and added back. Equal keys may be dealt over several partitions: whole rows
    are told apart by a spread column, so a value that holds a third of all rows is no hot partition.
    Null keys come first. ``df`` must not have columns size, part, before, row or spread.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.withColumn("size", size).withColumn("spread", F.monotonically_increasing_id())
             .repartitionByRange(partitions, *order, "spread").sortWithinPartitions(*order, "spread").drop("spread")
             .withColumn("part", F.spark_partition_id()))
    schema = StructType([*dealt.schema, StructField("before", LongType()), StructField("row", LongType())])
    local = base.stored(dealt.mapInArrow(_running, schema), "prefix")
    totals = local.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per partition of the shuffle above, at most `partitions` of them.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_rows"))
    return local.join(F.broadcast(offsets), "part").withColumns(
        {"before": F.col("before") + F.col("_bytes"), "row": F.col("row") + F.col("_rows")}).drop("part", "_bytes", "_rows")


def byte_shards(df: DataFrame, order: list[str], size: Column, shards: int, partitions: int | None = None) -> DataFrame:
    """``df`` with size, shard (0 to shards - 1) and slot (0, 1, ... within the shard, in ``order``).

    A row goes to the shard in whose byte range its middle lies, so every shard is off its target
    by less than the largest row. An empty table gives an empty table; a shard may be empty when
    one row is larger than a target.
    """
    placed = prefix_sums(df, order, size, partitions)
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))  # one row
    middle = (F.col("before").cast("decimal(38,0)") * 2 + F.col("size")) * shards
    shard = F.least(F.floor(middle / F.greatest(F.col("total") * 2, F.lit(1)).cast("decimal(20,0)")), F.lit(shards - 1)).cast("int")
    cut = placed.join(F.broadcast(total)).withColumn("shard", shard).drop("total", "before")
    first = cut.groupBy("shard").agg(F.min("row").alias("_first"))  # at most `shards` rows
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("row") - F.col("_first")).drop("_first", "row")
