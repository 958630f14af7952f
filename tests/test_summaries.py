"""Summaries are made where a text lies."""

from docloom.operators import enrichment as en


def test_texts_are_dealt_once(spark):
    text = "Zebra zebra ate. !!. The zebra slept. Nobody cares at all. Lions eat zebra. Ends"
    docs = spark.createDataFrame([(1, text), (1, text.lower()), (None, text), (2, "One. Two."), (3, None)], "doc_id LONG, text STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = en.summaries(docs, 6, 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, found.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moves = [line for line in plan.splitlines() if "Exchange" in line]
    assert moves and all("REPARTITION_BY_COL" in line for line in moves), plan
    assert rows == [(1, "Zebra zebra ate. zebra zebra ate.", 2), (2, "One. Two.", 2), (None, "Zebra zebra ate. !!.", 2)]
