"""Exact search in cells around pivots, and coded inverted lists, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import vector_cells as vc
from docloom.operators import vector_search as vs


def clustered(rng, n, dims=8, spread=0.15):
    centres = rng.normal(size=(6, dims))
    return centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))


def brute(rows, queries, k, floor, exclude_self=False):
    unit = lambda m: vs._unit(np.array(m))
    sims = np.round(unit([v for _, v in queries]) @ unit([v for _, v in rows]).T, 7)
    out = {}
    for (q, _), line in zip(queries, sims, strict=True):
        able = [(-s, i) for (i, _), s in zip(rows, line, strict=True) if (floor is None or s >= floor) and not (exclude_self and i == q)]
        out[q] = [(i, max(0.0, min(1.0, -s))) for s, i in sorted(able)[:k]]
    return {q: v for q, v in out.items() if v}


def lists_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.similarity))
    return out


@pytest.mark.parametrize("floor", [None, -0.5, 0.35, 0.95, 1.0])
@pytest.mark.parametrize("page_rows", [8, 4096])
def test_exact_in_cells(spark, floor, page_rows):
    """Equal vectors, a third in one place, zero vectors and string ids; few and many pages."""
    rng = np.random.default_rng(3)
    vectors = [(f"v{i:03}", v.tolist()) for i, v in enumerate(clustered(rng, 160))]
    vectors += [(f"w{i:03}", vectors[0][1]) for i in range(80)] + [("zero", [0.0] * 8)]
    queries = vectors[::7] + [("q", rng.normal(size=8).tolist()), ("z", [0.0] * 8)]
    v, q = spark.createDataFrame(vectors, "id string, vec array<double>"), spark.createDataFrame(queries, "query_id string, query_vec array<double>")
    got = lists_of(vc.top_k(q, v, 5, floor, exclude_self=True, page_rows=page_rows))
    want = brute(vectors, queries, 5, floor, True)
    assert {x: [i for i, _ in y] for x, y in got.items()} == {x: [i for i, _ in y] for x, y in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-7 for x in want for a, b in zip(got[x], want[x], strict=True))


def test_a_high_floor_spares_most_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 600, 16, 0.05))]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = v.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    pairs = lambda floor: vc.within(q, v, 1, floor, count_pairs=True).agg(F.sum("similarity")).first()[0]
    assert pairs(None) == 200 * 600 and pairs(0.95) < 0.4 * 200 * 600


def test_nulls_lengths_and_empty(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, None), (9, [1.0, 1.0, 0.0])], "query_id long, query_vec array<double>")
    assert lists_of(vc.top_k(q, v, 3, 0.5)) == {7: [(1, 1.0)], 9: [(3, 0.7071068)]}
    assert vc.top_k(q, v.limit(0), 3, 0.5).count() == 0 and vc.top_k(q.limit(0), v, 3, 0.5).count() == 0


def test_coded_lists(spark, tmp_path):
    """All rows are listed; probing everything is exact; a few probes find nine tenths where vectors lie in groups."""
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 900, 16, 0.3))]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = rows[::20]
    q = spark.createDataFrame(queries, "query_id long, query_vec array<double>")
    vc.build_lists(v, str(tmp_path / "l"))
    lists = vc.open_lists(spark, str(tmp_path / "l"))
    assert lists.rows.count() == lists.n == 900 and len(lists.codec.centres) == 30
    want = brute(rows, queries, 10, 0.2)
    everything = lists_of(vc.approximate(lists, q, 10, 0.2, 30, 900))
    assert {x: [i for i, _ in y] for x, y in everything.items()} == {x: [i for i, _ in y] for x, y in want.items()}
    some = lists_of(vc.approximate(lists, q, 10, 0.2, 8, 80))
    found = sum(i in {j for j, _ in some.get(x, [])} for x, y in want.items() for i, _ in y)
    assert found >= 0.9 * sum(map(len, want.values()))
    sizes = lists.rows.groupBy("cell").agg(F.count("*").alias("n"))
    assert vc.probed(lists, q, 8).join(sizes, "cell").agg(F.sum("n")).first()[0] < 0.6 * 900 * len(queries)
