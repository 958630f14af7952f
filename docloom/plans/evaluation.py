"""Evaluation queries: runs on the embeddings table, answers on the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import tables
from docloom.functions import selection
from docloom.operators import evaluation as ev
from docloom.operators import vector_search as vs
from docloom.plans import fragments as sq
from docloom.plans.registry import query
from docloom.plans.search import all_vectors

K = 20


def labels(spark, sf_dir):
    """Relevant for a query is every other vector with its label: the labels of all queries and of all vectors."""
    vectors = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    items = tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return vectors.join(items, "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "label"), vectors


def cosine_run(spark, sf_dir):
    out = vs.similar_to(tables.query_vectors(spark, sf_dir), all_vectors(spark, sf_dir), K)
    return out.select("query_id", F.col("id").alias("doc_id"), "rank")


def sign_run(spark, sf_dir):
    """The same search on one-bit vectors: the treatment arm."""
    signs = lambda c: F.transform(c, lambda x: F.when(x < 0, -1.0).otherwise(1.0))
    queries = tables.query_vectors(spark, sf_dir).withColumn("query_vec", signs(F.col("query_vec")))
    vectors = all_vectors(spark, sf_dir).withColumn("vec", signs(F.col("vec")))
    out = vs.similar_to(queries, vectors, K)
    return out.select("query_id", F.col("id").alias("doc_id"), "rank")


def metrics(spark, sf_dir, run=cosine_run, ks=(5, 10)):
    return ev.judged_metrics(*ev.judged_by_label(run(spark, sf_dir), *labels(spark, sf_dir)), ks)


_SIGN = "list_transform({}, lambda x: CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"
RUNS = f"""
qv AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
ev AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sc AS (SELECT query_id, doc_id, round(list_cosine_similarity(qv.v, ev.v), 7) AS a,
       round(list_cosine_similarity({_SIGN.format('qv.v')}, {_SIGN.format('ev.v')}), 7) AS b, qv.label = ev.label AS rel
       FROM qv, ev WHERE query_id <> doc_id),
ra AS (SELECT 'a' AS arm, query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, doc_id) AS rank FROM sc QUALIFY rank <= {K}),
rb AS (SELECT 'b' AS arm, query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS rank FROM sc QUALIFY rank <= {K}),
r AS (SELECT * FROM ra UNION ALL SELECT * FROM rb),
nr AS (SELECT query_id, count(*) FILTER (rel) AS n_rel FROM sc GROUP BY 1),
hits AS (SELECT arm, query_id, rel, rank, sum(CASE WHEN rel THEN 1 ELSE 0 END) OVER (PARTITION BY arm, query_id ORDER BY rank) AS c FROM r),
ideal AS (SELECT m, sum(1.0 / log2(i + 1)) AS idcg FROM (SELECT unnest(range(1, 101)) AS m), (SELECT unnest(range(1, 101)) AS i) WHERE i <= m GROUP BY 1),
mk AS (SELECT arm, query_id, k, n_rel, coalesce(1.0::DOUBLE / min(rank) FILTER (rel), 0) AS mrr,
  coalesce(sum(c / rank) FILTER (rel), 0) / n_rel AS ap,
  coalesce(sum(1.0 / log2(rank + 1)) FILTER (rel AND rank <= k), 0) AS dcg, count(*) FILTER (rel AND rank <= k) AS nh, least(k, count(*)) AS kk
  FROM hits JOIN nr USING (query_id), (SELECT unnest([5, 10]) AS k) GROUP BY arm, query_id, k, n_rel),
mt AS (SELECT arm, query_id, k, mrr, ap, dcg / idcg AS ndcg, nh / n_rel AS recall, nh / kk AS precision,
  CASE WHEN nh > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate FROM mk JOIN ideal ON m = least(n_rel, kk)),
lm AS (SELECT arm, query_id, 'mrr' AS metric, any_value(mrr) AS value FROM mt GROUP BY 1, 2
  UNION ALL SELECT arm, query_id, 'ap', any_value(ap) FROM mt GROUP BY 1, 2
  UNION ALL SELECT arm, query_id, 'ndcg_at_' || k, ndcg FROM mt UNION ALL SELECT arm, query_id, 'recall_at_' || k, recall FROM mt
  UNION ALL SELECT arm, query_id, 'precision_at_' || k, precision FROM mt UNION ALL SELECT arm, query_id, 'hit_rate_at_' || k, hit_rate FROM mt)"""
W = "WITH" + RUNS


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("evl1_mrr", W + " SELECT query_id, round(mrr, 6) AS mrr FROM mt WHERE arm = 'a' AND k = 10")
def evl1(spark, sf_dir):
    return rounded(metrics(spark, sf_dir, ks=[10]).select("query_id", "mrr"), "mrr")


@query("evl2_ndcg", W + " SELECT query_id, CAST(k AS INTEGER) AS k, round(ndcg, 6) AS ndcg FROM mt WHERE arm = 'a'")
def evl2(spark, sf_dir):
    return rounded(metrics(spark, sf_dir).select("query_id", "k", "ndcg"), "ndcg")


@query("evl3_recall", W + " SELECT query_id, CAST(k AS INTEGER) AS k, round(recall, 6) AS recall FROM mt WHERE arm = 'a'")
def evl3(spark, sf_dir):
    return rounded(metrics(spark, sf_dir).select("query_id", "k", "recall"), "recall")


@query("evl4_precision", W + " SELECT query_id, CAST(k AS INTEGER) AS k, round(precision, 6) AS precision FROM mt WHERE arm = 'a'")
def evl4(spark, sf_dir):
    return rounded(metrics(spark, sf_dir).select("query_id", "k", "precision"), "precision")


@query("evl5_hit_rate", W + " SELECT CAST(k AS INTEGER) AS k, round(avg(hit_rate), 6) AS hit_rate FROM mt WHERE arm = 'a' GROUP BY k")
def evl5(spark, sf_dir):
    return metrics(spark, sf_dir).groupBy("k").agg(F.round(F.avg("hit_rate"), 6).alias("hit_rate"))


@query("evl6_average_precision", W + " SELECT query_id, round(ap, 6) AS ap FROM mt WHERE arm = 'a' AND k = 10")
def evl6(spark, sf_dir):
    return rounded(metrics(spark, sf_dir, ks=[10]).select("query_id", "ap"), "ap")


@query(
    "evl7_all_metrics",
    W + """ SELECT query_id, CAST(k AS INTEGER) AS k, round(mrr, 6) AS mrr, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg,
round(recall, 6) AS recall, round(precision, 6) AS precision, hit_rate FROM mt WHERE arm = 'a'""",
)
def evl7(spark, sf_dir):
    return rounded(metrics(spark, sf_dir), "mrr", "ap", "ndcg", "recall", "precision")


@query(
    "evl8_run_summary",
    W + """ SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std,
round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.95), 6) AS p95 FROM lm WHERE arm = 'a' GROUP BY 1""",
)
def evl8(spark, sf_dir):
    return rounded(ev.summarise(ev.long_metrics(metrics(spark, sf_dir))), "mean", "median", "std", "min", "max", "p95")


def arms(spark, sf_dir):
    keep = F.col("metric").isin("mrr", "ndcg_at_10", "recall_at_10")
    return [ev.long_metrics(metrics(spark, sf_dir, run)).where(keep) for run in (cosine_run, sign_run)]


AB = W + """,
s AS (SELECT metric, count(*) FILTER (arm = 'a') AS n0, count(*) FILTER (arm = 'b') AS n1, avg(value) FILTER (arm = 'a') AS m0,
  avg(value) FILTER (arm = 'b') AS m1, var_samp(value) FILTER (arm = 'a') AS v0, var_samp(value) FILTER (arm = 'b') AS v1
  FROM lm WHERE metric IN ('mrr', 'ndcg_at_10', 'recall_at_10') GROUP BY 1),
t AS (SELECT *, (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)) AS t, n0 + n1 - 2 AS df FROM s),
p AS (SELECT metric, 1 - any_value(sin(atan(abs(t) / sqrt(df)))) * sum(exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(atan(t / sqrt(df))), 2 * j)) AS p
  FROM t, (SELECT unnest(range(0, 100000)) AS j) WHERE j <= (df - 2) / 2 GROUP BY metric)"""


@query(
    "evl9_ab_test",
    AB + """ SELECT metric, n0, n1, round(m0, 6) AS control, round(m1, 6) AS treatment, round((m1 - m0) * 100 / m0, 6) AS improvement_pct,
round(t, 6) AS t, df::DOUBLE AS df, round(p, 6) AS p_value, p < 0.05 AS significant FROM t JOIN p USING (metric)""",
)
def evl9(spark, sf_dir):
    return rounded(ev.ab_test(*arms(spark, sf_dir)), "control", "treatment", "improvement_pct", "t", "p_value")


@query(
    "evl9_recommendation",
    AB + """,
c AS (SELECT count(*) FILTER (p < 0.05 AND m1 > m0) AS better, count(*) FILTER (p < 0.05 AND m1 < m0) AS worse FROM t JOIN p USING (metric))
SELECT better, worse, CASE WHEN better > 0 AND worse = 0 THEN 'deploy_treatment' WHEN worse > 0 AND better = 0 THEN 'keep_control'
WHEN better > 0 THEN 'mixed' ELSE 'no_difference' END AS recommendation FROM c""",
)
def evl9_recommendation(spark, sf_dir):
    return ev.ab_recommendation(ev.ab_test(*arms(spark, sf_dir)))


@query(
    "evl10_compare_strategies",
    AB + """,
c AS (SELECT count(*) FILTER (p < 0.05 AND m0 > m1) AS wins, count(*) FILTER (p < 0.05 AND m0 < m1) AS losses,
  round(avg((m0 - m1) / m1), 6) AS mean_improvement FROM t JOIN p USING (metric))
SELECT *, CASE WHEN wins > losses THEN 'A' WHEN losses > wins THEN 'B' ELSE 'tie' END AS winner FROM c""",
)
def evl10(spark, sf_dir):
    return rounded(ev.compare_strategies(*arms(spark, sf_dir)), "mean_improvement")


def answer_pairs(spark, sf_dir):
    """A user turn with the assistant turn right after it: an equi-join, not a window."""
    turns = tables.load(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question"))
    given = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("q_turn"), F.col("text").alias("answer"))
    return asked.join(given, ["conv_id", "q_turn"])


PAIRS = f"""
pairs AS (SELECT u.conv_id, u.turn AS q_turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
pt AS (SELECT *, {sq.words_of('question')} AS qw, {sq.words_of('answer')} AS aw FROM pairs),
sz AS (SELECT *, len(list_distinct(qw)) AS nq, len(list_distinct(aw)) AS na, len(list_intersect(list_distinct(qw), list_distinct(aw))) AS nb FROM pt),
ts AS (SELECT *, CASE WHEN na = 0 THEN 0 ELSE nb / na END AS p, CASE WHEN nq = 0 THEN 0 ELSE nb / nq END AS r FROM sz)"""


@query(
    "evl11_threshold_alerts",
    W + "," + PAIRS + f""",
ctx AS (SELECT DISTINCT conv_id, unnest({sq.words_of('text')}) AS token FROM conversations WHERE role = 'user'),
ans AS (SELECT DISTINCT conv_id, q_turn, unnest(aw) AS token FROM pt),
fa AS (SELECT conv_id, q_turn, count(c.token) / count(*) AS f FROM ans LEFT JOIN ctx c USING (conv_id, token) GROUP BY 1, 2),
m(metric, value) AS (
  SELECT metric, avg(value) FROM lm WHERE arm = 'a' GROUP BY 1
  UNION ALL SELECT 'bertscore_f1', avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) FROM ts
  UNION ALL SELECT 'faithfulness', avg(f) FROM fa
  UNION ALL SELECT 'latency_p95_ms', quantile_cont(value * 20, 0.95) FROM events),
t(metric, threshold, is_min, severity) AS (VALUES ('mrr', 0.7, true, 'warning'), ('ndcg_at_10', 0.75, true, 'warning'), ('recall_at_5', 0.6, true, 'warning'),
  ('bertscore_f1', 0.85, true, 'warning'), ('faithfulness', 0.8, true, 'error'), ('latency_p95_ms', 1000.0, false, 'warning'))
SELECT metric, severity, round(value, 6) AS value, threshold::DOUBLE AS threshold FROM m JOIN t USING (metric)
WHERE (is_min AND value < threshold) OR (NOT is_min AND value > threshold)""",
)
def evl11(spark, sf_dir):
    pairs = answer_pairs(spark, sf_dir)
    means = ev.long_metrics(metrics(spark, sf_dir)).groupBy("metric").agg(F.avg("value").alias("value"))
    f1 = ev.token_set_scores(pairs).agg(F.lit("bertscore_f1").alias("metric"), F.avg("f1").alias("value"))
    faith = answer_faithfulness(spark, sf_dir).agg(F.lit("faithfulness").alias("metric"), F.avg("faithfulness").alias("value"))
    timed = tables.load(spark, sf_dir, "events").select(F.lit("latency_p95_ms").alias("metric"), (F.col("value") * 20).alias("ms"))
    latency = selection.quantiles(timed, ["metric"], "ms", {"value": 0.95})
    return rounded(ev.threshold_alerts(means.unionByName(f1).unionByName(faith).unionByName(latency)), "value")


@query(
    "evl12_token_set",
    "WITH" + PAIRS + """ SELECT conv_id, q_turn, round(p, 6) AS precision, round(r, 6) AS recall,
round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM ts""",
)
def evl12(spark, sf_dir):
    return rounded(ev.token_set_scores(answer_pairs(spark, sf_dir)).drop("question", "answer"), "precision", "recall", "f1")


def answer_faithfulness(spark, sf_dir):
    answers = answer_pairs(spark, sf_dir).select(
        F.struct("conv_id", "q_turn").alias("answer_id"), F.col("conv_id").alias("context_key"), "answer")
    said = tables.load(spark, sf_dir, "conversations").where(F.col("role") == "user").select(F.col("conv_id").alias("context_key"), "text")
    return ev.faithfulness(answers, said)


@query(
    "evl13_faithfulness",
    "WITH" + PAIRS + f""",
ctx AS (SELECT DISTINCT conv_id, unnest({sq.words_of('text')}) AS token FROM conversations WHERE role = 'user'),
ans AS (SELECT DISTINCT conv_id, q_turn, unnest(aw) AS token FROM pt)
SELECT conv_id, q_turn, round(count(c.token) / count(*), 6) AS faithfulness FROM ans LEFT JOIN ctx c USING (conv_id, token) GROUP BY 1, 2
UNION ALL SELECT conv_id, q_turn, 1.0 FROM pt WHERE len(aw) = 0""",
)
def evl13(spark, sf_dir):
    return rounded(answer_faithfulness(spark, sf_dir).select("answer_id.conv_id", "answer_id.q_turn", "faithfulness"), "faithfulness")


@query("evl14_answer_relevance", "WITH" + PAIRS + " SELECT conv_id, q_turn, round(r, 6) AS relevance FROM ts")
def evl14(spark, sf_dir):
    return rounded(ev.answer_relevance(answer_pairs(spark, sf_dir)).select("conv_id", "q_turn", "relevance"), "relevance")


_GRAM = "list_distinct(list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string({w}[i:i + {n} - 1], ' ')))"
_GRAMS = ", ".join(f"{_GRAM.format(w=w, n=n)} AS {w}{n}" for n in (1, 2, 3, 4) for w in ("aw", "qw"))
_GF = ", ".join(
    f"CASE WHEN len(aw{n}) > 0 AND len(qw{n}) > 0 THEN 2.0 * len(list_intersect(aw{n}, qw{n})) / (len(aw{n}) + len(qw{n})) END AS f{n}" for n in (1, 2, 3, 4))


@query(
    "evl15_ngram_overlap",
    "WITH" + PAIRS + f""",
g AS (SELECT conv_id, q_turn, {_GRAMS} FROM pt), f AS (SELECT conv_id, q_turn, {_GF} FROM g)
SELECT conv_id, q_turn, round(coalesce(list_avg(list_filter([f1, f2, f3, f4], lambda x: x IS NOT NULL)), 0), 6) AS ngram_f1 FROM f""",
)
def evl15(spark, sf_dir):
    return rounded(ev.ngram_overlap(answer_pairs(spark, sf_dir)).select("conv_id", "q_turn", "ngram_f1"), "ngram_f1")


@query("evl16_rouge_l")
def evl16(spark, sf_dir):
    return rounded(ev.rouge_l(answer_pairs(spark, sf_dir)).drop("question", "answer"), "precision", "recall", "f1")


@query(
    "evl17_rolling_usage",
    """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
SELECT strftime(d.day, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n, round(avg(value * 10), 6) AS avg_latency_ms,
  round(avg(CAST(json_extract(props, '$.k') AS DOUBLE) / 100), 6) AS avg_score
FROM d JOIN events ON CAST(ts AS DATE) BETWEEN d.day - 6 AND d.day GROUP BY 1, 2""",
)
def evl17(spark, sf_dir):
    events = tables.load(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("kind"), (F.col("value") * 10).alias("latency_ms"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("score"))
    out = rounded(ev.rolling_usage(events), "avg_latency_ms", "avg_score")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
