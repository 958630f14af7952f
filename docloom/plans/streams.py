"""Streaming queries: each runs its stream over the whole input, or the batch twin where SQL can check it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import tables
from docloom.plans.data import scratch
from docloom.plans.evaluation import rounded
from docloom.plans.registry import query
from docloom.streaming import ingest, stateful, windows


@query(
    "src2_new_objects",
    """
SELECT 'in/' || source || '/my file ' || doc_id || '.csv' AS path, 'my file ' || doc_id || '.csv' AS name, n_chars AS size, 'text/csv' AS mime_type, 'bucket-' || lang AS bucket FROM documents WHERE lang <> 'de'""",
)
def src2(spark, sf_dir):
    kind = F.when(F.col("lang") == "de", "s3:ObjectRemoved:Delete").otherwise("s3:ObjectCreated:Put")
    record = F.struct(kind.alias("eventName"), F.struct(
        F.struct(F.concat(F.lit("bucket-"), F.col("lang")).alias("name")).alias("bucket"),
        F.struct(F.concat(F.lit("in/"), F.col("source"), F.lit("/my+file%20"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("key"),
                 F.col("n_chars").alias("size"), F.lit('"e"').alias("eTag")).alias("object")).alias("s3"))
    path = scratch(spark, "notifications")
    tables.load(spark, sf_dir, "documents").select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("value")).write.text(path)
    found = ingest.run_to_table(ingest.new_objects(spark.readStream.text(path)), "objects")
    return found.select("path", "name", "size", "mime_type", "bucket")


def user_events(spark, sf_dir):
    return ingest.stream_table(spark, sf_dir, "events").withColumnRenamed("user_id", "key")


@query("str1_rate_limit")
def str1(spark, sf_dir):
    limited = ingest.run_to_table(stateful.rate_limit(user_events(spark, sf_dir), 2, 86400), "limited")
    return limited.groupBy("key").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


HEALTH = """
hs AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS ts, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS error_rate, avg(value) * 1000 AS latency_ms,
  count(*) AS n, max(value) AS peak FROM events GROUP BY 1)"""


@query(
    "str2_health_anomalies",
    "WITH" + HEALTH + """,
a(ts, anomaly, severity, component) AS (
  SELECT ts, 'high_error_rate', CASE WHEN error_rate > 0.25 THEN 'high' ELSE 'medium' END, 'pipeline' FROM hs WHERE error_rate > 0.1
  UNION ALL SELECT ts, 'high_latency', 'medium', 'pipeline' FROM hs WHERE latency_ms > 30000
  UNION ALL SELECT ts, 'queue_backlog', CASE WHEN n * 300 > 5000 THEN 'high' ELSE 'medium' END, 'queue' FROM hs WHERE n * 300 > 1000
  UNION ALL SELECT ts, 'memory_pressure', CASE WHEN peak * 200 > 12288 THEN 'critical' ELSE 'high' END, 'system' FROM hs WHERE peak * 200 > 8192
  UNION ALL SELECT ts, 'parser_degradation', 'high', 'parser:layout' FROM hs WHERE error_rate > 0.5
  UNION ALL SELECT ts, 'parser_degradation', 'high', 'parser:ocr' FROM hs WHERE peak > 80
  UNION ALL SELECT ts, 'destination_failure', 'high', 'destination:search' FROM hs WHERE n > 6)
SELECT epoch_us(ts) AS ts_us, anomaly, severity, component FROM a""",
)
def str2(spark, sf_dir):
    found = windows.anomalies(windows.health_samples(tables.load(spark, sf_dir, "events")))
    return found.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "anomaly", "severity", "component")


@query(
    "str3_health_trends",
    "WITH" + HEALTH + """,
w AS (SELECT DISTINCT time_bucket(INTERVAL '5 minutes', ts) - to_minutes(CAST(5 * i AS INTEGER)) AS start FROM hs, (SELECT unnest(range(0, 12)) AS i))
SELECT epoch_us(start) AS start_us, count(*) AS n, round(avg(error_rate), 6) AS error_rate_avg, round(max(error_rate), 6) AS error_rate_max,
  CASE WHEN arg_max(error_rate, ts) > arg_min(error_rate, ts) THEN 'increasing' ELSE 'decreasing' END AS error_rate_trend, round(avg(latency_ms), 4) AS latency_ms_avg,
  CASE WHEN arg_max(latency_ms, ts) > arg_min(latency_ms, ts) THEN 'increasing' ELSE 'decreasing' END AS latency_ms_trend
FROM w JOIN hs ON ts >= start AND ts < start + INTERVAL '60 minutes' GROUP BY start""",
)
def str3(spark, sf_dir):
    out = windows.trends(windows.health_samples(tables.load(spark, sf_dir, "events")))
    out = rounded(rounded(out, "error_rate_avg", "error_rate_max"), "latency_ms_avg", digits=4)
    return out.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n", "error_rate_avg", "error_rate_max", "error_rate_trend", "latency_ms_avg", "latency_ms_trend")


@query("str4_circuit_breaker")
def str4(spark, sf_dir):
    outcomes = user_events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    changes = ingest.run_to_table(stateful.circuit_breaker(outcomes, timeout_s=3600), "breaker")
    return changes.groupBy("key", "state").agg(F.count("*").alias("n"))


@query(
    "str5_continuous_ingest",
    """
WITH d AS (SELECT DISTINCT lang, text FROM documents),
c AS (SELECT lang, text, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i FROM d WHERE length(text) > 0)
SELECT lang, count(*) AS n_chunks, CAST(sum(length(substr(text, i * 800 + 1, 1000))) AS BIGINT) AS n_chars FROM c GROUP BY 1""",
)
def str5(spark, sf_dir):
    folder = ingest.new_folder(spark, "ingest")
    started = ingest.continuous_ingest(ingest.stream_table(spark, sf_dir, "documents"), f"{folder}/chunks", f"{folder}/checkpoint")
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/chunks").groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content").cast("long")).alias("n_chars"))


@query(
    "str6_daily_counts",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
)
def str6(spark, sf_dir):
    out = windows.daily_counts(tables.load(spark, sf_dir, "events"))
    return rounded(out, "value", digits=4).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "str7_heartbeat_sessions",
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id AS job_id, epoch_us(min(ts)) AS from_us, epoch_us(max(ts)) + 21600000000 AS stalled_us, count(*) AS n_beats FROM s GROUP BY user_id, s""",
)
def str7(spark, sf_dir):
    beats = tables.load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return windows.heartbeat_sessions(beats, "6 hours").select("job_id", micros("alive_from").alias("from_us"), micros("stalled_at").alias("stalled_us"), "n_beats")


@query("str8_retry_deadlines")
def str8(spark, sf_dir):
    attempts = user_events(spark, sf_dir).withColumn("ok", F.col("event_type") == "purchase")
    due = ingest.run_to_table(stateful.retry_deadlines(attempts, max_retries=3), "retries")
    return due.groupBy("what", "attempt").agg(F.count("*").alias("n"))
