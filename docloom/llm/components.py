"""Connected components by least neighbour labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import base


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in ``links`` (a, b).

    Each round takes the least label among a node's neighbours, then the label of that label, so
    long chains halve. Neighbours of a hub are reduced before they are sent. Every round is a table
    in the shared folder; the one before the last is deleted.
    """
    spark = links.sparkSession
    both = base.stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    path = base.work_path(spark, "labels")
    both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")).write.parquet(path)
    while True:
        labels = spark.read.schema("id LONG, component LONG").parquet(path)
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        least = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "m").alias("next"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("of"))
        step = least.join(jump, F.col("next") == F.col("at"), "left").select("id", F.least("next", F.coalesce("of", "next")).alias("next"), "component")
        following = base.work_path(spark, "labels")
        step.select("id", F.col("next").alias("component"), (F.col("next") < F.col("component")).alias("changed")).write.parquet(following)
        changed = spark.read.schema("id LONG, component LONG, changed BOOLEAN").parquet(following)
        done = changed.where("changed").limit(1).count() == 0
        base.delete(spark, path)
        path = following
        if done:
            return changed.select("id", "component")
