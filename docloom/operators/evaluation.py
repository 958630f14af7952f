"""Retrieval and answer evaluation over whole query batches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import selection, sizing, stats
from docloom.functions import text as tx

METRICS = ["mrr", "ap", "ndcg", "recall", "precision", "hit_rate"]


def retrieval_metrics(runs: DataFrame, qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Every metric for every (query, k) in one grouping.

    ``runs(query_id, doc_id, rank)`` and ``qrels(query_id, doc_id)``. A query keeps only the
    ranks of its relevant hits (at most its run depth); all metrics are arithmetic on them.
    Queries without results or without truth score 0. k is cut to the number of results first,
    so the ideal ranking is cut as well.
    """
    truth = qrels.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(True))
    judged = runs.join(truth, ["query_id", "doc_id"], "left")
    return judged_metrics(judged, truth.groupBy("query_id").agg(F.count("*").alias("n_rel")), ks)


def judged_by_label(runs: DataFrame, queries: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``runs`` with ``rel``, and the number of relevant documents per query, where a query's documents are those of its label, itself aside.

    ``queries(query_id, label)`` and ``documents(doc_id, label)``. Only retrieved pairs are judged,
    by their ids; what else is relevant enters as a count per label, so a label that a third of all
    documents share is never paired with its queries.
    """
    judged = runs.join(queries.select("query_id", F.col("label").alias("_asked")), "query_id").join(documents.select("doc_id", F.col("label").alias("_held")), "doc_id", "left").select(
        *[F.col(c) for c in runs.columns], ((F.col("_asked") == F.col("_held")) & (F.col("query_id") != F.col("doc_id"))).alias("rel"))
    sizes = documents.groupBy("label").agg(F.count("*").alias("n"))
    own = documents.select(F.col("doc_id").alias("query_id"), F.col("label").alias("_own"))
    wanted = queries.join(sizing.small_side(sizes, sizing.is_small(sizes)), "label").join(own, "query_id", "left").select(
        "query_id", (F.col("n") - F.coalesce((F.col("_own") == F.col("label")).cast("int"), F.lit(0))).alias("n_rel"))
    return judged, wanted.where("n_rel > 0")


def judged_metrics(judged: DataFrame, wanted: DataFrame, ks: Sequence[int]) -> DataFrame:
    """As :func:`retrieval_metrics`, from judged runs ``(query_id, doc_id, rank, rel)`` and ``wanted(query_id, n_rel)``."""
    found = judged.groupBy("query_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rel"), F.col("rank")))).alias("at"))
    both = found.join(wanted, "query_id", "full_outer").select(
        "query_id",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_rel", F.lit(0)).alias("n_rel"),
        F.coalesce("at", F.array().cast("array<int>")).alias("at"),
    )
    per_k = both.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    kk = F.least("k", "n")
    hits = F.filter("at", lambda r: r <= kk)
    gain = lambda ranks: F.aggregate(
        F.transform(ranks, lambda r: 1.0 / F.log2(r.cast("double") + 1)), F.lit(0.0), lambda a, x: a + x)
    ideal_n = F.least("n_rel", kk)
    ideal = gain(F.when(ideal_n > 0, F.sequence(F.lit(1).cast("long"), ideal_n)).otherwise(F.array().cast("array<long>")))
    ap = F.aggregate(F.transform("at", lambda r, i: (i + 1) / r), F.lit(0.0), lambda a, x: a + x)
    return per_k.select(
        "query_id",
        "k",
        F.coalesce(F.lit(1.0) / F.try_element_at("at", F.lit(1)), F.lit(0.0)).alias("mrr"),
        tx.ratio(ap, F.col("n_rel")).alias("ap"),
        tx.ratio(gain(hits), ideal).alias("ndcg"),
        tx.ratio(F.size(hits), F.col("n_rel")).alias("recall"),
        tx.ratio(F.size(hits), kk).alias("precision"),
        (F.size(hits) > 0).cast("double").alias("hit_rate"),
    )


def long_metrics(metrics: DataFrame) -> DataFrame:
    """``(query_id, metric, value)`` with the cut-off in the name where it matters."""
    flat = metrics.unpivot(["query_id", "k"], METRICS, "name", "value")
    by_k = ~F.col("name").isin("mrr", "ap")
    named = flat.withColumn("metric", F.when(by_k, F.concat("name", F.lit("_at_"), F.col("k").cast("string"))).otherwise(F.col("name")))
    return named.groupBy("query_id", "metric").agg(F.first("value").alias("value"))


def summarise(values: DataFrame) -> DataFrame:
    """Mean, median, population deviation, extremes and 95th percentile per metric; the quantiles are exact."""
    plain = values.groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    exact = selection.quantiles(values, ["metric"], "value", {"median": 0.5, "p95": 0.95})
    return plain.join(exact, "metric", "left").select("metric", "n", "mean", "median", "std", "min", "max", "p95")


def ab_statistics(control: DataFrame, treatment: DataFrame, key: str = "metric") -> DataFrame:
    """Means, improvement in per cent and the equal-variance t statistic per metric."""
    both = control.select(key, "value", F.lit(0).alias("arm")).unionByName(treatment.select(key, "value", F.lit(1).alias("arm")))
    arm = lambda a, f: f(F.when(F.col("arm") == a, F.col("value")))
    s = both.groupBy(key).agg(
        arm(0, F.count).alias("n0"), arm(1, F.count).alias("n1"), arm(0, F.avg).alias("m0"), arm(1, F.avg).alias("m1"),
        arm(0, F.var_samp).alias("v0"), arm(1, F.var_samp).alias("v1"))
    df = F.col("n0") + F.col("n1") - 2
    pooled = F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), df.cast("double"))
    spread = F.sqrt(pooled * (1.0 / F.col("n0") + 1.0 / F.col("n1")))
    return s.select(
        key, "n0", "n1", F.col("m0").alias("control"), F.col("m1").alias("treatment"),
        F.coalesce(F.try_divide((F.col("m1") - F.col("m0")) * 100, F.col("m0")), F.lit(0.0)).alias("improvement_pct"),
        F.try_divide(F.col("m0") - F.col("m1"), spread).alias("t"), df.cast("double").alias("df"),
    )


def ab_test(control: DataFrame, treatment: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Statistics with two-sided p-value and significance at the given confidence."""
    s = ab_statistics(control, treatment)
    p = F.when(F.col("t").isNull(), F.lit(1.0)).otherwise(stats.t_p_value("t", "df"))
    return s.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 1 - confidence)


def ab_recommendation(tested: DataFrame) -> DataFrame:
    """One verdict over all tested metrics."""
    up = F.count_if(F.col("significant") & (F.col("improvement_pct") > 0))
    down = F.count_if(F.col("significant") & (F.col("improvement_pct") < 0))
    counts = tested.agg(up.alias("better"), down.alias("worse"))
    return counts.withColumn(
        "recommendation",
        F.when((F.col("better") > 0) & (F.col("worse") == 0), "deploy_treatment")
        .when((F.col("worse") > 0) & (F.col("better") == 0), "keep_control")
        .when(F.col("better") > 0, "mixed").otherwise("no_difference"),
    )


def compare_strategies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fractional improvement of A over B, significant wins and losses, and the winner."""
    tested = ab_test(b, a)  # B is the base
    wins = tested.agg(
        F.count_if(F.col("significant") & (F.col("improvement_pct") > 0)).alias("wins"),
        F.count_if(F.col("significant") & (F.col("improvement_pct") < 0)).alias("losses"),
        F.avg(F.col("improvement_pct") / 100).alias("mean_improvement"),
    )
    return wins.withColumn("winner", F.when(F.col("wins") > F.col("losses"), "A").when(F.col("losses") > F.col("wins"), "B").otherwise("tie"))


# Alert thresholds (metric, limit, lower bound?, severity).
THRESHOLDS = [
    ("mrr", 0.70, True, "warning"),
    ("ndcg_at_10", 0.75, True, "warning"),
    ("recall_at_5", 0.60, True, "warning"),
    ("bertscore_f1", 0.85, True, "warning"),
    ("faithfulness", 0.80, True, "error"),
    ("latency_p95_ms", 1000.0, False, "warning"),
]


def threshold_alerts(metrics: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Metrics on the wrong side of their threshold. ``metrics(metric, value)``."""
    table = metrics.sparkSession.createDataFrame(thresholds, "metric string, threshold double, is_minimum boolean, severity string")
    broken = F.when(F.col("is_minimum"), F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return metrics.join(F.broadcast(table), "metric").where(broken).select("metric", "severity", "value", "threshold")


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def token_set_scores(pairs: DataFrame, a: str = "answer", b: str = "question") -> DataFrame:
    """Precision, recall and F1 of the two texts' token sets; 0 if either is empty."""
    x, y = F.array_distinct(tx.words(F.col(a))), F.array_distinct(tx.words(F.col(b)))
    sized = pairs.withColumn("_n", F.size(F.array_intersect(x, y))).withColumn("_x", F.size(x)).withColumn("_y", F.size(y))
    p, r = tx.ratio(F.col("_n"), F.col("_x")), tx.ratio(F.col("_n"), F.col("_y"))
    return sized.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(p, r)).drop("_n", "_x", "_y")


def faithfulness(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Share of an answer's distinct tokens found in any of its contexts; empty answers score 1.

    ``answers(answer_id, context_key, answer)``, ``contexts(context_key, text)``: a token-level
    join, so no context is gathered in one place.
    """
    tokens = answers.select("answer_id", "context_key", F.explode(F.array_distinct(tx.words(F.col("answer")))).alias("token"))
    known = contexts.select("context_key", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("token")).distinct()
    covered = tokens.join(known.withColumn("hit", F.lit(1)), ["context_key", "token"], "left").groupBy("answer_id").agg(
        F.count("*").alias("n"), F.count("hit").alias("hits"))
    return answers.select("answer_id").join(covered, "answer_id", "left").select(
        "answer_id", F.when(F.col("n").isNull(), 1.0).otherwise(tx.ratio(F.col("hits"), F.col("n"))).alias("faithfulness"))


def answer_relevance(pairs: DataFrame) -> DataFrame:
    """Share of the question's tokens covered by the answer."""
    q, a = F.array_distinct(tx.words(F.col("question"))), F.array_distinct(tx.words(F.col("answer")))
    covered = tx.ratio(F.size(F.array_intersect(q, a)), F.size(q))
    empty = (F.col("question") == "") | (F.col("answer") == "")
    score = F.when(empty, 0.0).when(F.size(q) == 0, (F.size(a) > 0).cast("double")).otherwise(F.least(F.lit(1.0), covered))
    return pairs.withColumn("relevance", score)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams as blank-joined strings; none if the text is shorter than n."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.array_distinct(F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>")))


def ngram_overlap(pairs: DataFrame, a: str = "answer", b: str = "question", max_n: int = 4) -> DataFrame:
    """Mean F1 of the n-gram sets for n = 1…max_n, over the n where both texts have n-grams."""
    toks = pairs.withColumn("_a", tx.words(F.col(a))).withColumn("_b", tx.words(F.col(b)))
    scores = []
    for n in range(1, max_n + 1):
        toks = toks.withColumn(f"_x{n}", ngrams(F.col("_a"), n)).withColumn(f"_y{n}", ngrams(F.col("_b"), n))
        both = F.size(F.array_intersect(f"_x{n}", f"_y{n}"))
        scores.append(F.when(
            (F.size(f"_x{n}") > 0) & (F.size(f"_y{n}") > 0),
            f1(tx.ratio(both, F.size(f"_x{n}")), tx.ratio(both, F.size(f"_y{n}")))))
    kept = F.array_compact(F.array(*scores))
    mean = tx.ratio(F.aggregate(kept, F.lit(0.0), lambda acc, s: acc + s), F.size(kept))
    helpers = ["_a", "_b", *[f"_{c}{n}" for n in range(1, max_n + 1) for c in "xy"]]
    return toks.withColumn("ngram_f1", mean).drop(*helpers)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one machine-word sweep per token of ``b``."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        matched = row & where.get(token, 0)
        row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)])


def rouge_l(pairs: DataFrame, a: str = "answer", b: str = "question") -> DataFrame:
    """ROUGE-L precision, recall and F1 from the token LCS."""
    toks = pairs.withColumn("_a", tx.words(F.col(a))).withColumn("_b", tx.words(F.col(b)))
    scored = toks.withColumn("lcs", lcs("_a", "_b"))
    p, r = tx.ratio(F.col("lcs"), F.size("_a")), tx.ratio(F.col("lcs"), F.size("_b"))
    return scored.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(p, r)).drop("_a", "_b")


def rolling_usage(requests: DataFrame, days: int = 7) -> DataFrame:
    """Per day the totals of the last ``days`` days: count, mean latency and score.

    ``requests(ts, kind, latency_ms, score)`` is first reduced to one row per day and kind, so
    the range window only sees calendar-sized data.
    """
    daily = requests.groupBy(F.to_date("ts").alias("day"), "kind").agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("latency"), F.sum("score").alias("score"))
    calendar = daily.select("day").distinct()
    spread = daily.select("*", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("until"))
    kept = spread.join(calendar.withColumnRenamed("day", "until"), "until", "left_semi")
    return kept.groupBy("until", "kind").agg(
        F.sum("n").alias("n"), F.sum("latency").alias("latency"), F.sum("score").alias("score"),
    ).select(F.col("until").alias("day"), "kind", "n", (F.col("latency") / F.col("n")).alias("avg_latency_ms"),
             (F.col("score") / F.col("n")).alias("avg_score"))
