"""Streams give what a plain loop or the batch form gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.streaming import ingest, stateful, windows

START = dt.datetime(2024, 1, 1)
SCHEMA = "key long, event_id long, ts timestamp, ok boolean, event_type string, value double"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three files in time order, read one per micro-batch."""
    rows = [((i * 7) % 3, i, START + dt.timedelta(seconds=40 * i + (i * i) % 37), (i // 40) % 3 == 2, ["error", "click"][i % 2], float(i % 11)) for i in range(240)]
    folder = str(tmp_path_factory.mktemp("events"))
    for n in range(3):
        spark.createDataFrame(rows[n * 80:(n + 1) * 80], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows, stream, spark.read.parquet(folder)


def micros(ts):
    return int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5)


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        keys.setdefault(r[0], []).append(r)
    return keys


def test_rate_limit(events):
    rows, stream, _ = events
    want = {}
    for _, rs in by_key(rows).items():
        accepted = []
        for r in rs:
            accepted = [t for t in accepted if t > micros(r[2]) - 600 * 10**6]
            want[r[1]] = len(accepted) <= 3
            if want[r[1]]:
                accepted.append(micros(r[2]))
    got = {r.event_id: r.allowed for r in ingest.run_to_table(stateful.rate_limit(stream(), 3, 600), "t").collect()}
    assert got == want and False in want.values()


@pytest.fixture(scope="module")
def late_events(spark, tmp_path_factory):
    """Files that are batches: hours 0 to 2 first, then twice rows behind the watermark beside one in time."""
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    files = [[(1, 0, at(0), False), (1, 1, at(120), False), (2, 2, at(120), True)], [(1, 3, at(1), True), (1, 4, at(121), False)], [(1, 5, at(2), True), (3, 6, at(3), False), (2, 7, at(122), True)]]
    folder = str(tmp_path_factory.mktemp("late"))
    for rows in files:
        spark.createDataFrame(rows, "key long, event_id long, ts timestamp, ok boolean").coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema("key long, event_id long, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).parquet(folder)


def test_rate_limit_gives_late_events_their_own_verdict(late_events):
    got = {r.event_id: r.allowed for r in ingest.run_to_table(stateful.rate_limit(late_events(), 0, 600), "t").collect()}
    assert got == {0: True, 1: True, 2: True, 3: None, 4: False, 5: None, 6: None, 7: False}


def test_admit_keeps_the_window_in_order():
    accepted = [100]
    assert stateful.admit(accepted, 95, 2, 50) and accepted == [95, 100]


def test_retry_deadlines_report_late_outcomes(late_events):
    got = [tuple(r) for r in ingest.run_to_table(stateful.retry_deadlines(late_events(), [3600], 4), "t").select("key", "attempt", "what", "due_s").collect()]
    seconds = lambda minutes: micros(START) // 10**6 + 60 * minutes
    assert sorted(r for r in got if r[2] == "late") == [(1, 2, "late", seconds(1)), (1, 3, "late", seconds(2)), (3, 0, "late", seconds(3))]
    assert [r for r in got if r[2] != "late"] == [(1, 1, "retry_due", seconds(60))]


def test_circuit_breaker(events):
    rows, stream, _ = events
    want = []
    for key, rs in by_key(rows).items():
        state = (stateful.CLOSED, 0, 0, 0)
        for r in rs:
            state, changes = stateful.advance(state, micros(r[2]), r[3], 3, 2, 300 * 10**6)
            want += [(key, r[1], c) for c in changes]
    got = [tuple(r) for r in ingest.run_to_table(stateful.circuit_breaker(stream(), 3, 2, 300), "t").select("key", "event_id", "state").collect()]
    assert sorted(got) == sorted(want) and {w[2] for w in want} == {"open", "half_open", "closed"}


def test_breaker_rules():
    s = (stateful.CLOSED, 0, 0, 0)
    for t in range(4):
        s, _ = stateful.advance(s, t, False, 5, 3, 60)
    s, changes = stateful.advance(s, 4, True, 5, 3, 60)  # a success does not reset the count
    s, changes = stateful.advance(s, 5, False, 5, 3, 60)
    assert changes == ["open"] and stateful.advance(s, 30, True, 5, 3, 60) == (s, [])
    s, changes = stateful.advance(s, 70, False, 5, 3, 60)
    assert changes == ["half_open", "open"]


def test_retry_deadlines(events):
    rows, stream, _ = events
    want = []
    for key, rs in by_key(rows).items():
        state = (0, 0)
        for r in rs:
            state, known = stateful.attempt(state, micros(r[2]), r[3], [60, 300], 4)
            want += [(key, n, due // 10**6, what) for n, due, what in known]
    last = max(micros(r[2]) for r in rows)
    got = [tuple(r) for r in ingest.run_to_table(stateful.retry_deadlines(stream(), [60, 300], 4), "t").select("key", "attempt", "due_s", "what").collect()]
    settled = lambda xs: sorted(x for x in xs if x[2] * 10**6 < last - 900 * 10**6)
    assert settled(got) == settled(want) and {w[3] for w in want} == {"retry_due", "exhausted"}


def run_complete(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(str, spark.table(name).collect()))


def test_daily_counts_and_trends_stream_equals_batch(spark, events):
    _, stream, batch = events
    assert run_complete(spark, windows.daily_counts(stream()), "daily") == sorted(map(str, windows.daily_counts(batch).collect()))
    samples = lambda df: df.select("ts", F.col("value").alias("error_rate"), (F.col("value") * 2).alias("latency_ms"))
    assert run_complete(spark, windows.trends(samples(stream())), "trends") == sorted(map(str, windows.trends(samples(batch)).collect()))


def test_closed_sessions_equal_batch(spark, events):
    _, stream, batch = events
    got = ingest.run_to_table(windows.heartbeat_sessions(stream().withColumnRenamed("key", "job_id"), "100 seconds"), "t").collect()
    want = windows.heartbeat_sessions(batch.withColumnRenamed("key", "job_id"), "100 seconds").collect()
    last = max(r.stalled_at for r in want) - dt.timedelta(seconds=800)
    settled = lambda rs: sorted(map(str, (r for r in rs if r.stalled_at < last)))
    assert settled(got) == settled(want) and settled(want)


def test_anomalies(spark):
    df = spark.createDataFrame([(1, 0.3, 31000.0, 6000, 13000.0, {"a": "unhealthy", "b": "healthy"}, {"d": "unhealthy"}), (2, 0.1, 1.0, 10, 1.0, {}, {})],
                               "ts int, error_rate double, latency_ms double, queue_depth int, memory_mb double, parser_health map<string,string>, destination_health map<string,string>")
    got = {(r.anomaly, r.severity, r.component) for r in windows.anomalies(df).collect()}
    assert got == {("high_error_rate", "high", "pipeline"), ("high_latency", "medium", "pipeline"), ("queue_backlog", "high", "queue"), ("memory_pressure", "critical", "system"),
                   ("parser_degradation", "high", "parser:a"), ("destination_failure", "high", "destination:d")}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_table_reads_files_and_folders_of_parts(spark, tmp_path, parts):
    rows = spark.range(90)
    if parts == 1:
        rows.toPandas().to_parquet(f"{tmp_path}/events.parquet")
    else:
        rows.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    rows.write.parquet(f"{tmp_path}/more_events.parquet")
    got = ingest.run_to_table(ingest.stream_table(spark, str(tmp_path), "events"), "t")
    assert sorted(r.id for r in got.collect()) == list(range(90))


def test_continuous_ingest_drops_repeats_and_resumes(spark, tmp_path):
    src, table, checkpoint = (str(tmp_path / n) for n in ("src", "table", "checkpoint"))
    schema = "doc_id long, text string, lang string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.continuous_ingest(spark.readStream.schema(schema).parquet(src), table, checkpoint).awaitTermination()
        return spark.read.parquet(table)

    assert arrive([(1, "a" * 1500, "en"), (2, "b" * 10, "en"), (3, "b" * 10, "en")]).count() == 3
    out = arrive([(4, "a" * 1500, "en"), (5, "c" * 10, "de")])
    assert out.count() == 4 and out.select("job_id", "chunk_index").distinct().count() == 4
