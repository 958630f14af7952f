"""Approximate and exact vector search against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from docloom.llm import ann, base, queries, topk
from tests.oracle import compare


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, id INT, cell INT")


def odd_rows(n=400, dims=8, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dims)], 0, 0) for i in range(n)]
    rows += [(n + i, [0.5] * dims, 1, 1) for i in range(60)]  # copies under many ids
    rows += [(1000, None, 0, 0), (1050, [None] * dims, 0, 0), (1100, [float("nan")] * dims, 0, 0), (1150, [float("inf")] * dims, 0, 0),
             (1200, [0.0] * dims, 0, 0), (None, [1.0] * dims, 0, 0), (1250, [1.0, 2.0], 0, 0), (1300, [], 0, 0), rows[50], rows[50]]
    return rows


def usable(rows, zero):
    ok = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows
          if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    return ok if zero else {i: v for i, v in ok.items() if (v != 0).any()}


def brute(rows, score, k, zero):
    ok, out = usable(rows, zero), {}
    for q in sorted(ok):
        if q % 50 == 0:
            scored = sorted((-score(ok[q], v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def cosine(a, b):
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def inner(a, b):
    return int(sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b)))


def results(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_neighbours_of_odd_vectors(spark):
    rows = odd_rows()
    got = results(ann.nearest(table(spark, rows), "vec_id", "embedding", 5, 50))
    want = {q: v for q, v in brute(rows, cosine, 5, False).items() if v}
    assert set(got) == set(want)
    for q, v in want.items():  # one leaf holds everything here, so the search is exact
        assert [i for i, _ in got[q]] == [i for i, _ in v]
        assert np.allclose([s for _, s in got[q]], [s for _, s in v])
    assert ann.nearest(table(spark, []), "vec_id", "embedding", 5, 50).count() == 0


def test_neighbours_recall_with_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 32)
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    monkeypatch.setattr(ann, "CELL_QUERIES", 7)
    rows = odd_rows(n=1500, dims=16)[:1560]
    got, want = results(ann.nearest(table(spark, rows), "vec_id", "embedding", 5, 50)), brute(rows, cosine, 5, False)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * 5 * len(want)
    for q, v in got.items():
        ok = usable(rows, False)
        assert all(abs(s - cosine(ok[q], ok[i])) < 1e-12 for i, s in v)


def test_neighbours_query_recall(spark):
    got = results(queries.QUERIES["op1_forest_neighbours"](spark, "/root/testdata/sf0.01"))
    rows = [(r.vec_id, r.embedding) for r in base.table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    want = brute(rows, cosine, 5, False)
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items()) >= 0.9 * 5 * len(want)


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "CELL_ROWS", 100)
    monkeypatch.setattr(topk, "CELL_QUERIES", 3)
    rows = odd_rows()
    got = results(topk.top_k(table(spark, rows), "vec_id", "embedding", 5, 50))
    assert got == {q: v for q, v in brute(rows, inner, 5, True).items() if v}
    assert topk.top_k(table(spark, []), "vec_id", "embedding", 5, 50).count() == 0


def test_blocks_are_pruned_and_exact():
    rng = np.random.default_rng(4)
    weights = np.concatenate([rng.integers(-5, 5, (topk.BLOCK, 6)), rng.integers(100, 110, (topk.BLOCK, 6)), rng.integers(-5, 5, (3 * topk.BLOCK + 7, 6))])
    ids, q = np.arange(len(weights)), rng.integers(1, 9, (9, 6))
    got, score, share = topk.top_of_blocks(ids, weights, np.array([-1] * 9), q, 5)
    full = q @ weights.T
    for i in range(9):
        best = sorted(zip(-full[i], ids))[:5]
        assert [int(x) for x in got[i]] == [b for _, b in best] and [int(-s) for s in score[i]] == [s for s, _ in best]
    assert share < 0.5
    big = np.array([[2**40, -1], [2**40, 1]])
    assert [int(x) for x in topk.top_of_blocks(np.array([1, 2]), big, np.array([0]), np.array([[2**20, 1]]), 2)[1][0]] == [2**60 + 1, 2**60 - 1]


def test_top_k_matches_sql(spark):
    ok, message, n = compare(spark, queries.QUERIES["op7_block_top_k"], queries.SQL["op7_block_top_k"], "sf0.01")
    assert ok, message
    assert n == 50


def test_counts_of_copies():
    assert Counter(len(r) for r in odd_rows())[4] == len(odd_rows())


def test_equal_scores_go_to_smaller_ids():
    """Vectors that differ in length only have one cosine: ids decide, in whatever order they lie."""
    rng = np.random.default_rng(1)
    ids = np.arange(1, 41)
    for _ in range(20):
        order = rng.permutation(40)
        v = np.outer(2.0 ** (order % 7), [1.0, 0.5, 0.25])
        got = ann._search_cells([[int(i)] for i in ids[order]], v, np.array([50, 3]), np.array([[3.0, 1.0, 1.0], [1.0, 0.5, 0.25]]), 5)
        assert [r[1] for r in got] == [1, 2, 3, 4, 5, 1, 2, 4, 5, 6]
