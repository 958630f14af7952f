import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import context as cx
from docloom.operators import embeddings as emb
from docloom.operators import fusion as fu
from docloom.operators import postings as ps
from docloom.operators import text_search as ts
from docloom.operators import vector_search as vs


def vectors(spark, n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).round(3)
    m[10] = m[11] = m[12]  # exact ties
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>").repartition(5)


def brute(m, q, k, floor):
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    sims = np.round(unit(m) @ unit(q).T, 7)
    out = set()
    for j in range(len(q)):
        order = sorted((i for i in range(len(m)) if floor is None or sims[i, j] >= floor), key=lambda i: (-sims[i, j], i))[:k]
        out |= {(j, i, r) for r, i in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("block_floats", [10**6, 20])
def test_top_k_is_exact_in_any_blocks(spark, monkeypatch, block_floats):
    monkeypatch.setattr(vs, "SCORE_CELLS", 50)
    m, df = vectors(spark)
    q = m[10:16]
    queries = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(q)], "query_id long, query_vec array<double>")
    got = {(r.query_id, r.id, r.rank) for r in vs.top_k(queries, df, 7, 0.1, block_floats=block_floats).collect()}
    assert got == brute(m, q, 7, 0.1)


def test_many_queries_within_a_small_budget(spark):
    m, df = vectors(spark)
    q = np.random.default_rng(8).normal(size=(500, m.shape[1]))
    queries = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(q)], "query_id long, query_vec array<double>")
    got = {(r.query_id, r.id, r.rank) for r in vs.top_k(queries, df, 3, None, score_cells=1000).collect()}
    assert got == brute(m, q, 3, None)


def test_ids_of_any_type_lengths_apart_and_checked_k(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [1.0, 0.0, 0.0])], "id string, vec array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [1.0, 0.0, 0.0])], "query_id string, query_vec array<double>")
    assert sorted((r.query_id, r.id, r.rank) for r in vs.top_k(q, df, 5).collect()) == [("q", "a", 1), ("q", "b", 2), ("r", "c", 1)]
    with pytest.raises(ValueError):
        vs.top_k(q, df, 5, max_k=3)


def test_repeated_terms_count_once(spark):
    c = spark.createDataFrame([("x", "one two"), ("y", "two"), ("z", "three")], "chunk_id string, content string")
    q = spark.createDataFrame([("q", ["one", "one", "two"])], "query_id string, terms array<string>")
    once = spark.createDataFrame([("q", ["one", "two"])], "query_id string, terms array<string>")
    index = ps.of(c)
    rows = lambda q: sorted((r.query_id, r.chunk_id, r.rank, r.score) for r in ps.ranked(index, q, 7).collect())
    assert rows(q) == rows(once) and [r[1] for r in rows(q)] == ["x", "y"]
    with pytest.raises(ValueError):
        ps.ranked(index, q, 5, max_k=3)


def test_highlight_quotes_terms(spark):
    df = spark.createDataFrame([("see a+b and (",)], "content string")
    assert df.select(ts.highlight(F.col("content"), F.array(F.lit("a+b"), F.lit("(")))).first()[0] == "see <mark>a+b</mark> and <mark>(</mark>"


def test_matches_come_before_ranking(spark):
    c = spark.createDataFrame([(1, "spark spark spark"), (2, "spark join"), (3, "join spark slow"), (4, "join")], "chunk_id long, content string")
    q = spark.createDataFrame([(9, ["join"], ["slow"], ["spark", "join"])], "query_id long, must array<string>, none_of array<string>, terms array<string>")
    index = ps.of(c)
    assert [(r.chunk_id, r.rank) for r in ps.ranked(index, q, 2).orderBy("rank").collect()] == [(2, 1), (4, 2)]
    assert [r.chunk_id for r in ps.ranked(index, q, 2, chunks=c.where("chunk_id > 2")).collect()] == [4]


def test_null_vectors_and_empty_queries(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert [r.id for r in vs.top_k(q, df, 5, 0.7).collect()] == [2]
    assert vs.top_k(q.limit(0), df, 5).count() == 0


def test_validation_names_the_first_problem(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [1.0, 2.0])], "id long, vec array<double>")
    assert [r.problem for r in vs.validate(df, 2).orderBy("id").collect()] == ["missing", "empty", "wrong_dimension", "not_finite", "ok"]


def test_quantised_constant_vector_is_zero(spark):
    df = spark.createDataFrame([(1, [2.0, 2.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    assert [list(r.codes) for r in emb.quantise(df).orderBy("id").collect()] == [[0, 0], [0, 255]]


def chunks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")


def test_boolean_clauses(spark):
    c = chunks(spark, "red fox runs", "the red dog", "fox red", "blue fox runs red")
    q = spark.createDataFrame([
        (1, ["red", "fox"], [], [], []), (2, [], ["dog", "blue"], [], []), (3, ["red"], [], ["dog"], []), (4, [], [], [], ["red fox"]), (5, ["absent"], [], [], []), (6, [], [], ["fox"], [])],
        "query_id long, must array<string>, any_of array<string>, none_of array<string>, phrases array<string>")
    got = {(r.query_id, r.chunk_id) for r in ps.search(ps.of(c), q, "match").collect()}
    assert got == {(1, 0), (1, 2), (1, 3), (2, 1), (2, 3), (3, 0), (3, 2), (3, 3), (4, 0), (6, 1)}


def test_trigram_similarity(spark):
    c, q = chunks(spark, "word", "words two"), spark.createDataFrame([(1, "word")], "query_id long, text string")
    asked = q.select("query_id", ts.trigrams(F.col("text")).alias("terms"))
    got = {r.chunk_id: r.score for r in ps.ranked(ps.of(c, ts.trigrams(F.col("content"))), asked, 5, "similar", threshold=0.1).collect()}
    assert got[0] == 1.0 and abs(got[1] - 4 / 11) < 1e-6


def test_term_coverage_counts_substrings(spark):
    q = spark.createDataFrame([(1, "own", 1), (1, "zzz", 1), (1, "br", 2)], "query_id long, term string, n long")
    got = {r.chunk_id: r.score for r in ts.term_coverage(q, chunks(spark, "Brown cow", "zzz", "none")).collect()}
    assert got == {0: 0.75, 1: 0.25}


def test_coverage_of_a_very_long_token(spark):
    """One pass over the text, whatever the length of its tokens; several shards and string ids."""
    rng = np.random.default_rng(2)
    texts = [("long", "ab" * 50_000 + "needle"), ("none", "zz"), ("null", None), *[(f"t{i}", " ".join(rng.choice(["ab", "xneedley", "b a", "c"], 6))) for i in range(80)]]
    c = spark.createDataFrame(texts, "chunk_id string, content string")
    terms = [(q, t, int(n)) for q in ("p", "q", "r") for t, n in zip(["ab", "needle", "aba", "c", "absent"], rng.integers(1, 4, 5))]
    got = {(r.query_id, r.chunk_id): r.score for r in ts.term_coverage(spark.createDataFrame(terms, "query_id string, term string, n long"), c, 100, shard_chars=9000).collect()}
    want = {}
    for query in ("p", "q", "r"):
        mine = [(t, n) for q, t, n in terms if q == query]
        for i, text in texts:
            hit = sum(n for t, n in mine if t in (text or ""))
            if hit:
                want[query, i] = round(hit / sum(n for _, n in mine), 9)
    assert got == want


def test_highlight_and_fragments(spark):
    c = chunks(spark, "Über den Fluss. fluss, Flusslauf " + "x " * 60 + "fluss end").withColumn("t", F.array(F.lit("fluss")))
    r = c.select(ts.highlight(F.col("content"), F.col("t")).alias("h"), ts.matched_terms(F.col("content"), F.col("t")).alias("m"), ts.fragments(F.col("content"), F.col("t")).alias("f")).first()
    assert r.h.startswith("Über den <mark>Fluss</mark>. <mark>fluss</mark>, Flusslauf") and r.m == ["fluss"] and len(r.f) == 2


def legs(spark):
    v = spark.createDataFrame([(1, 1, 0.95, 1), (1, 2, 0.85, 2), (1, 3, 0.75, 3), (2, 1, 0.9, 1)], "query_id long, chunk_id long, similarity double, rank int")
    t = spark.createDataFrame([(1, 2, 0.9, 1), (1, 4, 0.8, 2), (1, 5, 0.0, 3), (3, 1, 0.0, 1)], "query_id long, chunk_id long, rank_score double, rank int")
    return v, t


def test_weighted_sum(spark):
    got = {(r.query_id, r.chunk_id): round(r.score, 6) for r in fu.weighted_sum(*legs(spark)).collect()}
    assert got[(1, 2)] == round(0.7 * 0.85 + 0.3, 6) and got[(1, 4)] == round(0.3 * 0.8 / 0.9, 6) and got[(3, 1)] == 0.0


def test_rrf_is_symmetric(spark):
    v, t = legs(spark)
    swap = lambda df, a, b: df.withColumnRenamed(a, b)
    one = {(r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in fu.rrf(v, t).collect()}
    two = {(r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in fu.rrf(swap(t, "rank_score", "similarity"), swap(v, "similarity", "rank_score")).collect()}
    assert one == two and (1, 2, round(1 / 62 + 1 / 61, 9), 1) in one


@pytest.mark.parametrize("mode, queries", [("auto", {1, 2, 3}), ("strict", {1, 2, 3}), ("vector", {1, 2}), ("text", {1, 3})])
def test_fallback(spark, mode, queries):
    assert {r.query_id for r in fu.with_fallback(*legs(spark), mode).collect()} == queries


def test_dedup_keeps_slot_and_best_score_and_null_hashes(spark):
    r = spark.createDataFrame([(1, 10, "a", 0.5, 1), (1, 11, None, 0.4, 2), (1, 12, "a", 0.9, 3), (1, 13, None, 0.1, 4)], "query_id long, chunk_id long, content_hash string, score double, rank int")
    assert [(x.chunk_id, x.rank) for x in fu.dedup_by_hash(r).orderBy("rank").collect()] == [(12, 1), (11, 2), (13, 3)]


def test_rerank_squeezes_only_outside_the_unit_range(spark):
    c = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id long, chunk_id long, rank int")
    s = spark.createDataFrame([(1, 1, 0.4), (1, 2, 3.0), (1, 3, -2.0)], "query_id long, chunk_id long, raw_score double")
    assert [(r.chunk_id, r.rank) for r in fu.rerank(c, s, 2).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_filters_are_applied_and_checked(spark):
    f = fu.conditions({"a": {">=": 2, "<": 4}, "metadata": {"b": "x"}})
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "a int, b string")
    assert [r.a for r in df.where(fu.where_all(f, {"a": F.col("a"), "b": F.col("b")})).collect()] == [2]
    with pytest.raises(ValueError):
        fu.where_all(fu.conditions({"zz": 1}), {"a": F.col("a")})
    assert [r.a for r in df.where(fu.where_all(fu.conditions({"a": {"between": (2, 3)}}), {"a": F.col("a")})).collect()] == [2, 3]


def test_query_types_and_plan(spark):
    q = spark.createDataFrame([(1, "What is Spark?"), (2, "compare a and b"), (3, "zzz"), (4, "explain shuffles now")], "query_id long, text string")
    c = fu.classify_queries(q)
    assert [r.query_type for r in c.orderBy("query_id").collect()] == ["factual", "comparative", None, "analytical"]
    assert [r.plan for r in fu.retrieval_plan(c).orderBy("query_id").collect()] == ["auto_factual", "auto_comparative", "auto_vague", "auto_analytical"]


def test_quality_gate(spark):
    r = spark.createDataFrame([(1, i, 0.6, i) for i in range(1, 7)] + [(2, 1, 0.9, 1)], "query_id long, chunk_id long, s double, rank int")
    got = {x.query_id: (x.quality, x.needs_another_pass) for x in fu.quality_gate(r, "s").collect()}
    assert got == {1: (0.66, True), 2: (0.9, False)}


def test_window_context(spark):
    c = spark.createDataFrame([(1, i, f"c{i}") for i in range(4)], "doc_id long, chunk_index int, content string")
    got = [(r.previous, r.next) for r in cx.window_context(c, 2).orderBy("chunk_index").collect()]
    assert got == [(None, "c1 c2"), ("c0", "c2 c3"), ("c0 c1", "c3"), ("c1 c2", None)]


def test_null_texts_keep_their_rows(spark):
    texts = spark.createDataFrame([("a",), (None,)], "text string")
    cache = spark.createDataFrame([], "key string, embedding array<double>")
    assert sorted((str(r.text), r.embedding is None, r.hit) for r in emb.embed_with_cache(texts, cache, "m").collect()) == [("None", True, False), ("a", False, False)]
