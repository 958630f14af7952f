"""Evaluation, enrichment, sinks, ordered helpers and graphs."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import ordered, stats
from docloom.operators import enrichment as en
from docloom.operators import entities as ent
from docloom.operators import evaluation as ev
from docloom.operators import graph as gr
from docloom.operators import operations as ops
from docloom.operators import sinks
from docloom.sources import structured


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (2.0, 10, 0.0734), (0.0, 5, 1.0), (1.96, 1e6, 0.05), (12.706, 1, 0.05)])
def test_student_t_table_values(t, df, p):
    assert abs(stats.student_t_two_sided(t, df) - p) < 1e-4


def test_retrieval_metrics_by_hand(spark):
    runs = spark.createDataFrame([(1, d, r) for r, d in enumerate("abc", 1)] + [(2, "x", 1), (3, "a", 1)], "query_id long, doc_id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y"), (4, "z")], "query_id long, doc_id string")
    got = {r.query_id: r for r in ev.retrieval_metrics(runs, truth, [3]).collect()}
    dcg, ideal = 1 / np.log2(3) + 1 / np.log2(4), 1 + 1 / np.log2(3)
    assert (got[1].mrr, got[1].recall, got[1].hit_rate) == (0.5, 1.0, 1.0)
    assert abs(got[1].ndcg - dcg / ideal) < 1e-12 and abs(got[1].precision - 2 / 3) < 1e-12 and abs(got[1].ap - (1 / 2 + 2 / 3) / 2) < 1e-12
    for q in (2, 3, 4):
        assert [got[q][m] for m in ev.METRICS] == [0.0] * 6


def test_lcs_matches_the_table_method():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev, row = row, [0] * (len(b) + 1)
            for j, y in enumerate(b, 1):
                row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = ([str(x) for x in rng.integers(0, 5, rng.integers(0, 80))] for _ in range(2))
        assert ev.lcs_length(a, b) == table(a, b)


def test_empty_answers(spark):
    pairs = spark.createDataFrame([(1, 1, ""), (2, 1, "a b")], "answer_id long, context_key long, answer string")
    ctx = spark.createDataFrame([(1, "b c"), (1, "d")], "context_key long, text string")
    assert {r.answer_id: r.faithfulness for r in ev.faithfulness(pairs, ctx).collect()} == {1: 1.0, 2: 0.5}


def test_sentiment_and_topics_with_the_fixed_lists(spark):
    df = spark.createDataFrame([(1, "good great excellent love happy best win"), (2, "bad bad awful"), (3, "nothing")], "doc_id long, text string")
    assert [(r.label, round(r.sentiment, 2)) for r in en.sentiment(df).orderBy("doc_id").collect()] == [("very_positive", 0.7), ("negative", -0.3), ("neutral", 0.0)]
    t = spark.createDataFrame([("research on software and cloud data",), ("teaching research",), ("zzz",)], "text string")
    assert [(r.topic, r.topics) for r in en.topics(t).collect()] == [("technology", ["technology", "science", "education"]), ("education", ["education", "science"]), ("general", ["general"])]


def test_summary_matches_a_plain_loop(spark):
    import re

    text = "Alpha beta gamma alpha. Short one. Alpha gamma delta beta! Unrelated words appear here? Beta beta alpha gamma. Tail end bit. Alpha."
    sents = [s for s in re.split(r"(?<=[.!?])\s+", text) if s]
    freq = {}
    for w in re.findall(r"\w+", text.lower()):
        if len(w) > 3:
            freq[w] = freq.get(w, 0) + 1
    score = lambda s: sum(freq.get(w, 0) for w in re.findall(r"\w+", s.lower())) / len(re.findall(r"\w+", s))
    chosen, n = [], 0
    for s in sorted(sents, key=lambda s: -score(s))[:5]:
        if n + len(s.split()) <= 9:
            chosen.append(s)
            n += len(s.split())
    df = spark.createDataFrame([(1, text), (2, "One. Two.")], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in en.summaries(df, 9).collect()}
    assert got == {1: " ".join(s for s in sents if s in chosen), 2: "One. Two."}


def test_entities_with_offsets(spark):
    text = "Write to Ann@x.org or b@y.de by 12/31/2024, see https://a.b/c?d (pay $1,200.50 or 30 EUR, 15%) call 555-123-4567. März: éa@b.co Jan 5, 2024"
    got = {(r.entity_type, r.entity_text): text[r.start_pos:r.end_pos] for r in ent.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert all(k[1] == v for k, v in got.items())
    assert {("email", "Ann@x.org"), ("url", "https://a.b/c?d"), ("date", "12/31/2024"), ("date", "Jan 5, 2024"), ("money", "$1,200.50"), ("money", "30 EUR"), ("percent", "15%"), ("phone", "555-123-4567")} <= set(got)
    assert ("email", "a@b.co") not in got


def test_upsert_table_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "job_id long, chunk_index int, content string, created string")
    up = lambda rows: {r.action: r.n for r in sinks.upsert_table(spark, path, make(rows), ["job_id", "chunk_index"], ["content"], 4).collect()}
    first = [(j, i, "a", "t1") for j in range(20) for i in range(2)]
    assert up(first) == {"inserted": 40}
    for _ in range(2):
        counts = up([(3, 0, "b", "t2"), (99, 0, "new", "t2")])
    assert counts["updated"] == 2 and "inserted" not in counts
    back = {(r.job_id, r.chunk_index): (r.content, r.created) for r in spark.read.parquet(path).collect()}
    assert len(back) == 41 and back[(3, 0)] == ("b", "t1") and back[(3, 1)] == ("a", "t1") and back[(99, 0)] == ("new", "t2")


def test_upsert_layout_repeats_and_replaced_groups(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "job_id long, chunk_index int, content string")
    up = lambda rows, **more: {r.action: r.n for r in sinks.upsert_table(spark, path, make(rows), ["job_id", "chunk_index"], ["content"], **more).collect()}
    assert up([(1, i, "a") for i in range(4)] + [(2, 0, "a")], buckets=2) == {"inserted": 5}
    with pytest.raises(ValueError):
        up([(1, 0, "b")], buckets=3)
    up([(5, 0, "x"), (5, 0, "y"), (5, 0, "y")], order=["content"])
    assert [r.content for r in spark.read.parquet(path).where("job_id = 5").collect()] == ["y"]
    assert up([(1, 0, "new"), (1, 1, "new")], replace=["job_id"])["removed"] == 2
    assert sorted((r.job_id, r.chunk_index, r.content) for r in spark.read.parquet(path).collect()) == [(1, 0, "new"), (1, 1, "new"), (2, 0, "a"), (5, 0, "y")]


def test_patterns_are_judged_by_the_engine_that_runs_them(spark):
    df = spark.createDataFrame([("ab",)], "s string")
    ok = lambda pattern: df.select(sinks.filter_passes(sinks.Filter("s", "regex", pattern), {"s": F.col("s")})).first()[0]
    assert ok("a(?<n>b)") and not ok("a(?P<n>b)") and not ok("(")


def test_delimiters_per_file_and_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;n_id;a.b\n1;2;"x ""y"", z"\n')
    (tmp_path / "b.csv").write_text('id,n_id,a.b\n3,4,"one\nline"\n')
    df = structured.read_delimited(spark, str(tmp_path), multi_line=True)
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2", 'x "y", z'), ("3", "4", "one\nline")]
    assert {r.column: r.type for r in structured.column_types(df).collect()} == {"id": "integer", "n_id": "integer", "a.b": "string"}


def test_retention_rules(spark):
    items = spark.createDataFrame([("raw_file", None), ("raw_file", {"job_status": "done"}), ("raw_file", {"job_status": "failed"}), ("other", None)], "data_type string, metadata map<string,string>")
    assert [r.rule for r in ops.match_retention(items).collect()] == ["failed_job_data", "raw_files", "failed_job_data", "default"]


def test_delimited_types(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("i\tf\td\ts\te\tm\n1\t1.5\t2024-01-01\tx\t\t1\n-2\t3\t01/02/2024\t5\t\tx\n")
    df = structured.read_delimited(spark, str(tmp_path / "t.tsv"))
    assert {r.column: r.type for r in structured.column_types(df).collect()} == {"i": "integer", "f": "float", "d": "date", "s": "string", "e": "unknown", "m": "string"}


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, spread over many slices."""
    rng = np.random.default_rng(5)
    rows = [(0 if rng.random() < 0.8 else int(rng.integers(1, 6)), int(rng.integers(0, 30)), i, float(round(rng.random(), 4))) for i in range(1500)]
    return spark.createDataFrame(rows, "g int, slice int, id long, v double").cache()


def test_sliced_helpers_equal_plain_windows(spark, skewed):
    w = Window.partitionBy("g").orderBy("slice", "id")
    plain = skewed.select("id", F.row_number().over(w).cast("long").alias("rn"), F.lag("id").over(w).alias("before"))
    numbered = ordered.sliced_row_number(skewed, ["g"], "slice", ["id"])
    lagged = ordered.sliced_lag(skewed, ["g"], "slice", ["id"], F.col("id"), "before")
    assert plain.join(numbered.select("id", F.col("rn").alias("rn2")), "id").where("rn <> rn2").isEmpty()
    assert plain.join(lagged.select("id", F.col("before").alias("b2")), "id").where("NOT before <=> b2").isEmpty()


def test_order_statistic_equals_sorting(spark, skewed):
    got = {r.g: r.picked for r in ordered.order_statistic(skewed, ["g"], "v", F.floor(F.col("n") * 0.95).cast("long"), width=0.05).collect()}
    rows = skewed.collect()
    for g in range(6):
        values = sorted(r.v for r in rows if r.g == g)
        assert got[g] == values[int(len(values) * 0.95)]


def cliques(spark):
    """Two cliques of five joined by one edge."""
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    return spark.createDataFrame(pairs, "src string, dst string")


def test_communities_of_two_cliques(spark):
    edges = cliques(spark)
    for labels in (gr.greedy_modularity(edges), gr.label_propagation(edges, 20)):
        groups = {}
        for r in labels.collect():
            groups.setdefault(r.label, set()).add(r.id[0])
        assert sorted(map(sorted, groups.values())) == [["a"], ["b"]]
    score = gr.modularity(edges, gr.greedy_modularity(edges)).first()
    assert abs(score.standard - (40 / 42 - 2 * (21 / 42) ** 2)) < 1e-9
    levels = gr.multi_level(edges, 2)
    assert levels.where("level = 1").select("label").distinct().count() == 2 and levels.where("level = 2").count() == 10


def test_labels_settle_on_a_two_sided_graph(spark):
    pairs = [(f"a{i}", f"b{j}") for i in range(4) for j in range(3)] + [(f"c{i}", f"d{j}") for i in range(3) for j in range(4)] + [("a0", "d0")]
    labels = {r.id: r.label for r in gr.label_propagation(spark.createDataFrame(pairs, "src string, dst string"), 60).collect()}
    again = {r.id: r.label for r in gr.label_propagation(spark.createDataFrame(pairs, "src string, dst string"), 61).collect()}
    assert labels == again and len(set(labels.values())) <= 3


def test_pagerank_without_known_seeds_is_empty(spark):
    triples = spark.createDataFrame([("a", "p", "b")], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([(1, "zz")], "query_id int, entity string")
    assert gr.personalised_pagerank(triples, seeds).count() == 0


def test_passages_of_an_empty_graph(spark):
    links = spark.createDataFrame([], "entity string, passage_id long")
    scores = spark.createDataFrame([], "query_id int, node string, score double")
    asked = spark.createDataFrame([(1, True)], "query_id int, has_seeds boolean")
    got = gr.rank_passages(scores, links, spark.range(5).withColumnRenamed("id", "passage_id"), asked, 2).collect()
    assert sorted((r.query_id, r.passage_id, r.score) for r in got) == [(1, 3, 1.0), (1, 4, 1.0)]


def test_pagerank_equals_dense_power_iteration(spark):
    triples = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "q", "d"), ("a", "q", "b"), ("e", "p", "f")]
    names = sorted({x for s, _, o in triples for x in (s, o)})
    at = {n: i for i, n in enumerate(names)}
    a = np.zeros((6, 6))
    for s, _, o in triples:
        a[at[s], at[o]] += 1
        a[at[o], at[s]] += 1
    p = a / a.sum(axis=1, keepdims=True)
    seeds = {1: ["a", "missing"], 2: ["d"]}
    df = spark.createDataFrame([(q, e) for q, es in seeds.items() for e in es], "query_id int, entity string")
    got = gr.personalised_pagerank(spark.createDataFrame(triples, "subject string, predicate string, object string"), df, rounds=9, tolerance=1e-9).collect()
    for q, es in seeds.items():
        jump = np.zeros(6)
        for e in es:
            if e in at:
                jump[at[e]] = 0.15 / len(es)
        exact = jump
        for _ in range(8):
            exact = jump + 0.85 * p.T @ exact
        for r in got:
            if r.query_id == q:
                assert abs(r.score - exact[at[r.node]]) < 1e-12
        assert sum(r.score for r in got if r.query_id == q) <= 1 + 1e-9
    early = gr.personalised_pagerank(spark.createDataFrame(triples, "subject string, predicate string, object string"), df, rounds=50, tolerance=1.0).collect()
    assert {r.node for r in early if r.query_id == 2} == {"d", "c"}


def test_cooccurrence_from_seeds_equals_all_pairs(spark):
    rows = [("x", 1), ("y", 1), ("z", 1), ("x", 2), ("y", 2), ("w", 3)]
    inc = spark.createDataFrame(rows, "node_id string, chunk_id long")
    got = {(r.seed_id, r.node_id, r.first_chunk, r.n_chunks) for r in gr.cooccurring(inc, spark.createDataFrame([("x",), ("w",)], "node_id string")).collect()}
    assert got == {("x", "y", 1, 2), ("x", "z", 1, 1)}


def test_labels_judge_like_pairs(spark):
    """Counts per label and judged hits give what all pairs of a label give, also for queries that are no documents."""
    documents = spark.createDataFrame([(i, i % 3 if i < 30 else None) for i in range(34)], "doc_id long, label int")
    queries = spark.createDataFrame([(1, 1), (2, 2), (5, 0), (100, 0), (101, 7), (32, None)], "query_id long, label int")
    runs = spark.createDataFrame([(q, d, r) for q in (1, 2, 5, 100, 101, 32) for r, d in enumerate([q % 34, 4, 7, 3, 6, 99, 32], 1)], "query_id long, doc_id long, rank int")
    pairs = queries.join(documents, "label").where("query_id <> doc_id").select("query_id", "doc_id")
    as_set = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}
    want = as_set(ev.retrieval_metrics(runs, pairs, [3, 7]))
    assert as_set(ev.judged_metrics(*ev.judged_by_label(runs, queries, documents), [3, 7])) == want and len(want) == 12
