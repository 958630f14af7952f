"""Events are added up by type before they meet subscriptions."""


def test_fan_out_moves_one_row_per_type_and_subscription(spark, tmp_path):
    """Events are added up by type first; null types and ids, unknown and repeated types are kept as the pairs would count them."""
    from docloom.plans import operations

    spark.createDataFrame([(1, "click"), (2, "click"), (None, "click"), (5, "view"), (7, None), (None, "signup")], "event_id LONG, event_type STRING").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(1, "BUILDING", 6000.0), (2, "HOUSEHOLD", 6000.0), (3, "MACHINERY", 6000.0), (4, "BUILDING", 10.0), (5, "OTHER", 6000.0)],
                          "c_custkey LONG, c_mktsegment STRING, c_acctbal DOUBLE").write.parquet(str(tmp_path / "customer.parquet"))
    got = operations.ops18(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 3), (2, 2, 5)]
    joined = got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "Aggregate [event_type" in joined
