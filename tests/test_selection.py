"""Exact quantiles against numpy: one value in most rows, wide ranges."""

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import selection


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {
        "tied": np.where(rng.random(3000) < 0.9, 0.25, rng.random(3000)), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "same": np.full(500, -7.0),
        "wide": rng.choice([-1, 1], 2000) * 10.0 ** rng.uniform(-200, 200, 2000), "plain": rng.normal(size=2500)}
    # The values as numpy sees them.
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("plain", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r.g: r for r in selection.quantiles(df, ["g"], "x", {"p10": 0.1, "median": 0.5, "p95": 0.95}).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        want = np.quantile(xs, [0.1, 0.5, 0.95])
        assert np.allclose([got[g].p10, got[g].median, got[g].p95], want, rtol=1e-12, atol=0), g


def test_a_tied_group_is_a_count(spark):
    """A value in nine tenths of a group is one row from the first step on."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 < 9, F.lit(1.5)).otherwise(F.col("id").cast("double")).alias("x"))
    indexes = spark.createDataFrame([("g", 0), ("g", 17_999), ("g", 18_000), ("g", 19_999)], "g string, index long")
    got = {r["index"]: r["value"] for r in selection.at_indexes(df, ["g"], "x", indexes).collect()}
    assert got == {0: 1.5, 17_999: 1.5, 18_000: 9.0, 19_999: 19_999.0}


def test_a_long_group_lies_in_many_tasks(spark):
    df = spark.range(50_000).select(F.lit("g").alias("g"), F.rand(3).alias("x"))
    parts = df.groupBy("g", F.col("x").alias("v")).count().repartitionByRange(4, "g", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and selection.cumulated(df, ["g"], "x").agg(F.max("upto")).first()[0] == 50_000
