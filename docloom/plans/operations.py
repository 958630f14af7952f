"""Operational queries on tables derived from orders, events, lineitem and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import tables
from docloom.operators import operations as ops
from docloom.plans.evaluation import rounded
from docloom.plans.registry import query

NOW = f"TIMESTAMP '{tables.FIXED_CLOCK}'"


def clock():
    return F.to_timestamp(F.lit(tables.FIXED_CLOCK))


JOBS = f"""
jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'pending' END AS status, o_orderpriority AS source_type,
  o_orderdate AS created_at, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS locked_at,
  CASE WHEN o_orderpriority <> '5-LOW' THEN {NOW} - to_seconds(CAST(floor(o_totalprice) AS BIGINT) % 900) END AS heartbeat_at FROM orders)"""


def jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("pending")
    beat = F.timestamp_seconds(F.unix_timestamp(clock()) - F.floor("o_totalprice") % 900)
    return tables.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("source_type"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("locked_at"), F.when(F.col("o_orderpriority") != "5-LOW", beat).alias("heartbeat_at"))


@query(
    "ops1_job_listing",
    "WITH" + JOBS + """ SELECT job_id, source_type, epoch_us(created_at) AS created_us, (SELECT count(*) FROM jobs WHERE status = 'processing') AS total
FROM jobs WHERE status = 'processing' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 40""",
)
def ops1(spark, sf_dir):
    return ops.list_jobs(jobs(spark, sf_dir), status="processing", page_no=3, limit=20).select(
        "job_id", "source_type", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "total")


@query("ops2_stalled_jobs", "WITH" + JOBS + f" SELECT job_id, source_type FROM jobs WHERE status = 'processing' AND locked_at IS NOT NULL AND (heartbeat_at IS NULL OR heartbeat_at < {NOW} - to_seconds(300))")
def ops2(spark, sf_dir):
    return ops.stalled_jobs(jobs(spark, sf_dir), clock()).select("job_id", "source_type")


CODES = ["PARSE_FAIL", "LOW_SCORE", "TIMED OUT", "OOM_KILLED", "DNS_LOOKUP", "AUTH_DENIED", "SCHEMA_MISMATCH", "E_UNKNOWN", "E42"]
MESSAGES = ["bad quality", "read timeout", "something broke", "score missing"]
_CODE = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_MSG = "[" + ", ".join(f"'{c}'" for c in MESSAGES) + "]"


def _sql_rules(rules, column):
    return " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in rules)


DLQ = f"""
dlq0 AS (SELECT event_id AS id, ts AS created_at, 'file_' || user_id || CASE WHEN value > 25 THEN '.PDF' ELSE '.csv' END AS file_name,
  {_CODE}[1 + user_id % {len(CODES)}] AS error_code, {_MSG}[1 + event_id % {len(MESSAGES)}] AS error_message,
  CASE WHEN value > 40 THEN 'archived' WHEN value > 20 THEN 'retrying' ELSE 'pending' END AS status, CASE WHEN user_id < 50 THEN 's3' ELSE 'upload' END AS source_type
  FROM events WHERE event_type = 'error'),
dlq AS (SELECT *, CASE {_sql_rules(ops.FAILURE_CODES, 'error_code')} {_sql_rules(ops.FAILURE_MESSAGES, 'error_message')} ELSE 'unknown_error' END AS failure_category FROM dlq0)"""


def dead_letters(spark, sf_dir):
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values)).cast("int") + 1)
    rows = tables.load(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.concat(F.lit("file_"), F.col("user_id").cast("string"), F.when(F.col("value") > 25, ".PDF").otherwise(".csv")).alias("file_name"),
        pick(CODES, "user_id").alias("error_code"), pick(MESSAGES, "event_id").alias("error_message"),
        F.when(F.col("value") > 40, "archived").when(F.col("value") > 20, "retrying").otherwise("pending").alias("status"),
        F.when(F.col("user_id") < 50, "s3").otherwise("upload").alias("source_type"))
    return rows.withColumn("failure_category", ops.failure_category(F.col("error_code"), F.col("error_message")))


@query("ops3_failure_categories", "WITH" + DLQ + " SELECT failure_category, count(*) AS n, count(DISTINCT error_code) AS n_codes FROM dlq GROUP BY 1")
def ops3(spark, sf_dir):
    return dead_letters(spark, sf_dir).groupBy("failure_category").agg(F.count("*").alias("n"), F.countDistinct("error_code").alias("n_codes"))


@query(
    "ops4_dead_letter_search",
    "WITH" + DLQ + """,
f AS (SELECT * FROM dlq WHERE status = 'retrying' AND source_type = 'upload' AND created_at >= TIMESTAMP '2024-01-03 00:00:00' AND created_at <= TIMESTAMP '2024-01-28 00:00:00'
  AND regexp_matches(lower(file_name), '^file_.*[0-9]\\.pdf$') AND (contains(lower(file_name), 'e_') OR contains(lower(error_message), 'e_') OR contains(lower(error_code), 'e_')))
SELECT id, file_name, failure_category, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, id LIMIT 25 OFFSET 5""",
)
def ops4(spark, sf_dir):
    return ops.search_dead_letters(
        dead_letters(spark, sf_dir), status="retrying", source_type="upload", date_from="2024-01-03 00:00:00", date_to="2024-01-28 00:00:00",
        name_glob="FILE_*[0-9].pdf", search="E_", limit=25, offset=5).select("id", "file_name", "failure_category", "total")


@query(
    "ops5_dead_letter_statistics",
    "WITH" + DLQ + f""",
a AS (SELECT status, failure_category, floor(epoch({NOW} - created_at) / 86400) AS d FROM dlq),
b AS (SELECT *, CASE WHEN d < 1 THEN 'less_than_1_day' WHEN d < 7 THEN '1_to_7_days' WHEN d < 30 THEN '7_to_30_days' ELSE 'more_than_30_days' END AS age FROM a)
SELECT 'status' AS dimension, status AS value, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'failure_category', failure_category, count(*) FROM b GROUP BY 2
UNION ALL SELECT 'age', age, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM b""",
)
def ops5(spark, sf_dir):
    return ops.dead_letter_statistics(dead_letters(spark, sf_dir), clock())


AUDIT = """
audit AS (SELECT event_id AS id, ts AS "timestamp", event_type, CASE WHEN user_id < 5 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, 'c' || user_id AS correlation_id FROM events)"""


def audit(spark, sf_dir):
    return tables.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "event_type", F.when(F.col("user_id") >= 5, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("correlation_id"))


@query(
    "ops6_audit_query",
    "WITH" + AUDIT + """,
f AS (SELECT * FROM audit WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND event_type IN ('click', 'purchase') AND user_id IN (7, 8, 9, 10, 11, 12, 13, 14, 15) AND status = 'success')
SELECT id, event_type, user_id, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 100 AS has_more FROM f ORDER BY "timestamp" DESC, id LIMIT 50 OFFSET 50""",
)
def ops6(spark, sf_dir):
    return ops.query_audit(
        audit(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-20 00:00:00", {"event_type": ["click", "purchase"], "user_id": list(range(7, 16))},
        status="success", page_no=2, page_size=50).select("id", "event_type", "user_id", "total", "has_more")


@query(
    "ops7_audit_summary",
    "WITH" + AUDIT + """ SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM audit GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM audit GROUP BY 2
UNION ALL SELECT 'user_id', coalesce(CAST(user_id AS VARCHAR), 'anonymous'), count(*) FROM audit GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM audit""",
)
def ops7(spark, sf_dir):
    return ops.audit_summary(audit(spark, sf_dir))


LINEAGE = """
lin AS (SELECT user_id AS job_id, event_type AS stage, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_order, ts,
  CAST(floor(value) AS BIGINT) AS ms, sha256(props) AS output_hash, props FROM events)"""


def lineage(spark, sf_dir):
    from docloom.functions.ordered import sliced_row_number

    rows = tables.load(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").alias("timestamp"), "event_id", F.to_date("ts").alias("day"),
        F.floor("value").alias("duration_ms"), F.sha2("props", 256).alias("output_hash"), "props")
    return sliced_row_number(rows, ["job_id"], "day", ["timestamp", "event_id"], "step_order")


@query(
    "ops8_lineage_chain",
    "WITH" + LINEAGE + " SELECT job_id, stage || '_' || step_order AS node, lag(stage || '_' || step_order) OVER (PARTITION BY job_id ORDER BY step_order) AS from_node FROM lin",
)
def ops8(spark, sf_dir):
    return ops.lineage_chain(lineage(spark, sf_dir)).select("job_id", "node", "from_node")


@query(
    "ops9_lineage_summary",
    "WITH" + LINEAGE + """,
s AS (SELECT job_id, stage, min(step_order) AS f, count(*) AS n, min(ts) AS a, max(ts) AS b, sum(ms) AS ms FROM lin GROUP BY 1, 2)
SELECT job_id, CAST(sum(n) AS BIGINT) AS n_steps, count(*) AS n_stages, string_agg(stage, ',' ORDER BY f) AS stages, epoch_us(min(a)) AS start_us, epoch_us(max(b)) AS stop_us,
  CAST(nullif(sum(ms), 0) AS BIGINT) AS total_ms FROM s GROUP BY 1""",
)
def ops9(spark, sf_dir):
    return ops.lineage_summary(lineage(spark, sf_dir)).select(
        "job_id", "n_steps", "n_stages", "stages", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("stop").cast("timestamp")).alias("stop_us"), "total_ms")


@query(
    "ops10_integrity",
    "WITH" + LINEAGE + """,
f AS (SELECT job_id, stage, arg_min(output_hash, step_order) AS h FROM lin GROUP BY 1, 2),
c AS (SELECT user_id AS job_id, event_type AS stage, arg_max(props, (ts, event_id)) AS data FROM events GROUP BY 1, 2 UNION ALL SELECT DISTINCT user_id, 'unknown', 'x' FROM events)
SELECT c.stage, count(*) AS n, count(*) FILTER (coalesce(sha256(data) = h, false)) AS n_intact FROM c LEFT JOIN f USING (job_id, stage) GROUP BY 1""",
)
def ops10(spark, sf_dir):
    events = tables.load(spark, sf_dir, "events")
    latest = events.groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage")).agg(F.max_by("props", F.struct("ts", "event_id")).alias("data"))
    unknown = events.select(F.col("user_id").alias("job_id")).distinct().select("job_id", F.lit("unknown").alias("stage"), F.lit("x").alias("data"))
    checked = ops.verify_integrity(latest.unionByName(unknown), lineage(spark, sf_dir))
    return checked.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("intact").alias("n_intact"))


TYPES = ["raw_file", "processed_data", "temp_file", "audit_log", "scratch"]
_TYPES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
ITEMS = f"""
items AS (SELECT d.doc_id, n_chars, {_TYPES}[1 + CAST(substr(source, 4) AS INTEGER) % {len(TYPES)}] AS data_type, {NOW} - to_days(CAST(n_chars % 200 AS INTEGER)) AS created_at,
  l.doc_id IS NULL AS bare, CASE WHEN toxic = 1 THEN 'failed' ELSE 'done' END AS job_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
matched AS (SELECT *, CASE WHEN data_type = 'raw_file' AND (bare OR job_status = 'failed') THEN 'failed_job_data' WHEN data_type = 'raw_file' THEN 'raw_files' WHEN data_type = 'processed_data' THEN 'processed_data'
  WHEN data_type = 'temp_file' THEN 'temporary_files' WHEN data_type = 'audit_log' THEN 'audit_logs' ELSE 'default' END AS rule FROM items),
planned AS (SELECT *, CASE rule WHEN 'failed_job_data' THEN 14 WHEN 'raw_files' THEN 30 WHEN 'processed_data' THEN 90 WHEN 'temporary_files' THEN 1 ELSE 2555 END AS days,
  CASE rule WHEN 'processed_data' THEN 'archive' WHEN 'audit_logs' THEN 'keep' WHEN 'default' THEN 'keep' ELSE 'delete' END AS action FROM matched)"""


def retention_items(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.expr("CAST(substr(source, 4) AS INT)") % len(TYPES)) + 1)
    docs = tables.load(spark, sf_dir, "documents").join(tables.load(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "failed").otherwise("done")
    return docs.select(
        "doc_id", "n_chars", kind.alias("data_type"), F.timestamp_seconds(F.unix_timestamp(clock()) - (F.col("n_chars") % 200) * 86400).alias("created_at"),
        F.when(F.col("toxic").isNotNull(), F.create_map(F.lit("job_status"), status)).alias("metadata"))


@query("ops11_retention_rules", "WITH" + ITEMS + " SELECT data_type, rule, CAST(days AS INTEGER) AS retention_days, action, count(*) AS n FROM planned GROUP BY ALL")
def ops11(spark, sf_dir):
    return ops.match_retention(retention_items(spark, sf_dir)).groupBy("data_type", "rule", "retention_days", "action").agg(F.count("*").alias("n"))


@query(
    "ops12_retention_plan",
    "WITH" + ITEMS + f""" SELECT CASE WHEN {NOW} > created_at + to_days(days) THEN action ELSE 'keep' END AS planned, count(*) AS n, count(*) FILTER ({NOW} > created_at + to_days(days)) AS n_expired,
CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM planned GROUP BY 1""",
)
def ops12(spark, sf_dir):
    return ops.retention_plan(retention_items(spark, sf_dir), clock()).groupBy("planned").agg(
        F.count("*").alias("n"), F.count_if("expired").alias("n_expired"), F.sum("n_chars").alias("n_bytes"))


HISTORY = """
hist AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS parser, p_type AS content_type, p_brand AS file_type, l_linestatus = 'F' AS success, 1 - l_discount AS quality, l_quantity * 100 AS time_ms,
  CASE WHEN l_tax > 0.05 THEN 'parse' WHEN l_tax > 0.02 THEN 'timeout' ELSE 'other' END AS error_type, l_shipdate AS ts FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def history(spark, sf_dir):
    part = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return tables.load(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("parser"), F.col("p_type").alias("content_type"), F.col("p_brand").alias("file_type"),
        (F.col("l_linestatus") == "F").alias("success"), (1 - F.col("l_discount")).alias("quality"), (F.col("l_quantity") * 100).alias("time_ms"),
        F.when(F.col("l_tax") > 0.05, "parse").when(F.col("l_tax") > 0.02, "timeout").otherwise("other").alias("error_type"), F.col("l_shipdate").alias("timestamp"))


_PERF = "count(*) AS attempts, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(quality), 6) AS mean_quality, round(avg(time_ms), 6) AS mean_time_ms FROM hist GROUP BY 2"


@query("ops13_performance", "WITH" + HISTORY + f" SELECT 'parser' AS dimension, parser AS value, {_PERF} UNION ALL SELECT 'content_type', content_type, {_PERF}")
def ops13(spark, sf_dir):
    return rounded(ops.performance(history(spark, sf_dir), ["parser", "content_type"]), "success_rate", "mean_quality", "mean_time_ms")


@query(
    "ops14_recommendation",
    "WITH" + HISTORY + """,
req AS (SELECT DISTINCT p_type AS content_type, CASE WHEN p_size > 45 THEN 'Brand#99' ELSE p_brand END AS file_type FROM part UNION SELECT 'image', 'png' UNION SELECT 'novel', 'txt'),
s AS (SELECT r.content_type, r.file_type, h.parser, count(*) AS n, count(*) FILTER (success) AS ok, sum(quality) AS q FROM req r JOIN hist h ON h.content_type = r.content_type OR h.file_type = r.file_type GROUP BY ALL),
b AS (SELECT content_type, file_type, arg_max(parser, (round(ok / n * 0.7::DOUBLE + q / n * 0.3::DOUBLE, 9), parser)) AS parser, sum(n) AS n FROM s GROUP BY 1, 2)
SELECT r.content_type, r.file_type, coalesce(b.parser, CASE WHEN r.content_type = 'image' THEN 'ocr' ELSE 'layout' END) AS parser,
  round(CASE WHEN n IS NULL THEN 0.7 ELSE least(0.95, 0.5 + n / 100 * 0.45) END::DOUBLE, 6) AS confidence FROM req r LEFT JOIN b USING (content_type, file_type)""",
)
def ops14(spark, sf_dir):
    ext = F.when(F.col("p_size") > 45, "Brand#99").otherwise(F.col("p_brand"))
    requests = tables.load(spark, sf_dir, "part").select(F.col("p_type").alias("content_type"), ext.alias("file_type")).distinct()
    requests = requests.unionByName(spark.createDataFrame([("image", "png"), ("novel", "txt")], "content_type string, file_type string"))
    return rounded(ops.recommend_parser(requests, history(spark, sf_dir)), "confidence")


@query(
    "ops15_tuned_thresholds",
    "WITH" + HISTORY + """,
h2 AS (SELECT content_type, CASE WHEN file_type = 'Brand#11' THEN 'TIFF' WHEN file_type = 'Brand#22' THEN 'zip' ELSE file_type END AS file_type, quality FROM hist),
s AS (SELECT content_type, count(*) AS n, avg(quality) AS m FROM h2 GROUP BY 1)
SELECT content_type, file_type, n, round(CASE WHEN n >= 5 THEN greatest(0.5, least(0.9, m * 0.9)) END::DOUBLE, 6) AS tuned,
  round(greatest(0.5, least(0.95, CASE WHEN n > 10 THEN 0.49 + m * 0.3 ELSE 0.7 END * CASE WHEN lower(file_type) IN ('tiff', 'zip') THEN 0.9 ELSE 1 END))::DOUBLE, 6) AS adaptive
FROM (SELECT DISTINCT content_type, file_type FROM h2) JOIN s USING (content_type)""",
)
def ops15(spark, sf_dir):
    """Two brands stand for file types that are hard to read."""
    kind = F.when(F.col("file_type") == "Brand#11", "TIFF").when(F.col("file_type") == "Brand#22", "zip").otherwise(F.col("file_type"))
    return rounded(ops.tune_thresholds(history(spark, sf_dir).withColumn("file_type", kind)), "tuned", "adaptive")


@query(
    "ops15_score_history",
    "WITH" + HISTORY + """,
r AS (SELECT parser, l.q, row_number() OVER (PARTITION BY parser ORDER BY q) - 1 AS i, count(*) OVER (PARTITION BY parser) AS n FROM (SELECT parser, quality - CASE WHEN success THEN 0 ELSE 0.3 END AS q FROM hist) l),
s AS (SELECT parser, any_value(n) AS n, avg(q) AS m, avg(CASE WHEN q >= 0.7 THEN 1.0::DOUBLE ELSE 0 END) AS pr, max(q) FILTER (i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) AS picked FROM r GROUP BY 1)
SELECT parser, n, round(m, 6) AS mean, round(pr, 6) AS pass_rate, round(greatest(0.5, least(0.95, CASE WHEN pr < 0.95 THEN picked ELSE greatest(0.7, m * 0.9) END))::DOUBLE, 2) AS threshold FROM s""",
)
def ops15_history(spark, sf_dir):
    scores = history(spark, sf_dir).select("parser", (F.col("quality") - F.when(F.col("success"), 0.0).otherwise(0.3)).alias("score"))
    return rounded(ops.score_history_threshold(scores, "parser", "score"), "mean", "pass_rate")


@query(
    "ops16_failure_patterns",
    "WITH" + HISTORY + """, f AS (SELECT * FROM hist WHERE NOT success)
SELECT 'parser' AS dimension, parser AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'content_type', content_type, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'error_type', error_type, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM f""",
)
def ops16(spark, sf_dir):
    return ops.failure_patterns(history(spark, sf_dir))


@query(
    "ops16_common_errors",
    "WITH" + HISTORY + """, f AS (SELECT l_tax, error_type FROM hist JOIN lineitem ON id = l_orderkey * 10 + l_linenumber WHERE NOT success)
SELECT error_type || '_' || CAST(CAST(l_tax * 100 AS INTEGER) AS VARCHAR) AS error_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, error_type || '_' || CAST(CAST(l_tax * 100 AS INTEGER) AS VARCHAR)) AS rank
FROM f GROUP BY 1 QUALIFY rank <= 5""",
)
def ops16_common(spark, sf_dir):
    """The five commonest of the finer error types."""
    tax = tables.load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("tax"))
    finer = history(spark, sf_dir).join(tax, "id").withColumn("error_type", F.concat_ws("_", "error_type", "tax"))
    return ops.common_errors(finer, 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    "ops16_recent_failures",
    "WITH" + HISTORY + " SELECT id, parser, error_type FROM hist WHERE NOT success AND ts >= TIMESTAMP '2000-01-01 00:00:00' - to_hours(720) ORDER BY ts DESC, id LIMIT 100",
)
def ops16_recent(spark, sf_dir):
    return ops.recent_failures(history(spark, sf_dir), F.to_timestamp(F.lit("2000-01-01 00:00:00")), 720, 100).select("id", "parser", "error_type")


DELIVERIES = f"""
dl AS (SELECT o_orderkey AS id, 'sub' || o_custkey % 20 AS subscription, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'retrying' ELSE CASE WHEN o_totalprice > 300000 THEN 'failed' ELSE 'pending' END END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS attempts, CASE WHEN o_totalprice < 50000 THEN NULL ELSE {NOW} + to_seconds(CAST(floor(o_totalprice) AS BIGINT) % 2000 - 1000) END AS next_retry_at FROM orders)"""


def deliveries(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "retrying").when(F.col("o_totalprice") > 300000, "failed").otherwise("pending")
    retry = F.timestamp_seconds(F.unix_timestamp(clock()) + F.floor("o_totalprice") % 2000 - 1000)
    return tables.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("sub"), (F.col("o_custkey") % 20).cast("string")).alias("subscription"), status.alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("attempts"), F.when(F.col("o_totalprice") >= 50000, retry).alias("next_retry_at"))


@query(
    "ops17_delivery_statistics",
    "WITH" + DELIVERIES + """ SELECT coalesce(subscription, 'all') AS subscription, count(*) AS n, count(*) FILTER (status = 'delivered') AS n_delivered, count(*) FILTER (status = 'failed') AS n_failed,
count(*) FILTER (status IN ('pending', 'retrying')) AS n_open, round(count(*) FILTER (status = 'delivered') / count(*), 6) AS success_rate FROM (SELECT subscription, status FROM dl) GROUP BY ROLLUP (subscription)""",
)
def ops17(spark, sf_dir):
    return rounded(ops.delivery_statistics(deliveries(spark, sf_dir)), "success_rate")


@query(
    "ops17_due_retries",
    "WITH" + DELIVERIES + f""" SELECT id, CAST(attempts AS INTEGER) AS attempts, CAST([0, 60, 300, 900, 3600][least(attempts + 1, 5)] AS INTEGER) AS next_wait_s FROM dl
WHERE status IN ('pending', 'retrying') AND attempts < 5 AND (next_retry_at IS NULL OR next_retry_at <= {NOW})""",
)
def ops17_due(spark, sf_dir):
    return ops.due_retries(deliveries(spark, sf_dir), clock()).select("id", "attempts", "next_wait_s")


@query(
    "ops18_fan_out",
    """
WITH s AS (SELECT c_custkey AS subscription_id, CASE c_mktsegment WHEN 'BUILDING' THEN ['click', 'purchase'] WHEN 'MACHINERY' THEN ['error'] WHEN 'HOUSEHOLD' THEN ['view', 'view', 'signup'] ELSE ['none'] END AS ts FROM customer WHERE c_acctbal > 5000),
x AS (SELECT DISTINCT subscription_id, unnest(ts) AS event_type FROM s)
SELECT subscription_id, count(*) AS n_events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events JOIN x USING (event_type) GROUP BY 1""",
)
def ops18(spark, sf_dir):
    lists = {"BUILDING": ["click", "purchase"], "MACHINERY": ["error"], "HOUSEHOLD": ["view", "view", "signup"]}
    types = F.array(F.lit("none"))
    for segment, names in lists.items():
        types = F.when(F.col("c_mktsegment") == segment, F.array(*[F.lit(n) for n in names])).otherwise(types)
    subs = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subscription_id"), types.alias("event_types"), (F.col("c_acctbal") > 5000).alias("active"))
    # Events of a type reach the same subscriptions, so they are added up before they are fanned out and not after.
    events = tables.load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return ops.fan_out(events, subs).groupBy("subscription_id").agg(F.sum("n").alias("n_events"), F.sum("ids").alias("id_sum"))


RUNS = "runs AS (SELECT event_type AS stage, ts, event_type <> 'error' OR value < 10 AS success, value / 50 AS seconds FROM events)"


def runs(spark, sf_dir):
    return tables.load(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"), "ts", ((F.col("event_type") != "error") | (F.col("value") < 10)).alias("success"), (F.col("value") / 50).alias("seconds"))


@query(
    "ops19_timing_summary",
    "WITH " + RUNS + """ SELECT stage, count(*) AS n, count(*) FILTER (success) AS n_success, round(count(*) FILTER (success) / count(*) * 100, 6) AS success_pct, round(avg(seconds) FILTER (seconds > 0), 6) AS mean_s,
round(min(seconds) FILTER (seconds > 0), 6) AS min_s, round(max(seconds) FILTER (seconds > 0), 6) AS max_s, round(count(*) FILTER (success) / (floor(epoch(max(ts))) - floor(epoch(min(ts)))) * 60, 6) AS per_minute FROM runs GROUP BY 1""",
)
def ops19(spark, sf_dir):
    return rounded(ops.timing_summary(runs(spark, sf_dir), "stage"), "success_pct", "mean_s", "min_s", "max_s", "per_minute")


_BOUNDS = ", ".join(f"('{b}', {b}::DOUBLE)" for b in ops.HISTOGRAM_BOUNDS)


@query(
    "ops19_duration_histogram",
    "WITH " + RUNS + f", b(le, bound) AS (VALUES {_BOUNDS}, ('+Inf', 'inf'::DOUBLE)) SELECT stage, le, count(*) FILTER (seconds <= bound) AS n FROM runs, b GROUP BY 1, 2",
)
def ops19_histogram(spark, sf_dir):
    return ops.duration_histogram(runs(spark, sf_dir), "stage")
