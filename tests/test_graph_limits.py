"""Iterations that end by their limit say so; converged forms are registered."""

import warnings

import pytest

import __spark_entry__ as entry
from docloom.operators import graph
from docloom.plans import graph as plans


def test_label_propagation_reports_its_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    with pytest.warns(UserWarning, match="after 1 rounds"):
        graph.label_propagation(edges, rounds=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        graph.label_propagation(edges, rounds=1, stop_when_stable=False)


@pytest.mark.parametrize("name", ["grf15_converged", "grf16_converged"])
def test_converged_forms_rank_by_converged_scores(monkeypatch, name):
    def asked(*_):
        raise LookupError("converged")

    monkeypatch.setattr(plans, "converged_pagerank", asked)
    with pytest.raises(LookupError, match="converged"):
        entry.queries()[name](None, "")


def test_scores_take_every_pair_once(spark):
    """Edges given twice, both ways, as loops or with null ends; a node with two labels counts with both."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), (None, "a"), ("c", "d")], "src STRING, dst STRING")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("d", 2)], "id STRING, label INT")
    assert sorted(map(tuple, graph.undirected(edges).collect())) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert graph.coverage(edges, labels).first()[0] == 1.0  # a-b once, c-d twice, of three pairs
    assert graph.coverage(edges.limit(0), labels).first()[0] == 0.0
    scores = graph.modularity(edges, labels).first()
    assert abs(scores.edge_only - (6 - (2 * 2 + 4 * 2) / 6) / 6) < 1e-12 and abs(scores.standard - (1 - (9 + 16) / 36)) < 1e-12


def test_triples_of_more_lines_come_from_more_tasks(spark, tmp_path, monkeypatch):
    lines = [(i % 40, i % 7, i % 3) for i in range(300)]
    spark.createDataFrame(lines, "l_orderkey LONG, l_partkey LONG, l_suppkey LONG").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, i % 5) for i in range(40)], "o_orderkey LONG, o_custkey LONG").write.parquet(str(tmp_path / "orders.parquet"))
    few = sorted(map(tuple, plans.raw_triples(spark, str(tmp_path)).collect()))
    size = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*.parquet"))
    monkeypatch.setattr(plans, "LINE_BYTES", size // 10)
    many = plans.raw_triples(spark, str(tmp_path))
    assert sorted(map(tuple, many.collect())) == few and len(few) == 600
    assert many.rdd.getNumPartitions() >= 10
