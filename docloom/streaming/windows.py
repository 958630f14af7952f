"""Event-time windows and stateless checks; every function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits for error rate, latency in ms, queue depth, memory in MB.
LIMITS = {"error_rate": 0.1, "latency_ms": 30000.0, "queue_depth": 1000, "memory_mb": 8192.0}
SEVERE = {"error_rate": 0.25, "queue_depth": 5000, "memory_mb": 12288.0}


def watermarked(df: DataFrame, column: str, delay: str) -> DataFrame:
    return df.withWatermark(column, delay) if df.isStreaming else df


def anomalies(samples: DataFrame, limits=LIMITS, severe=SEVERE) -> DataFrame:
    """One row per broken limit or unhealthy component: ``(ts, anomaly, severity, component, value)``.

    ``samples(ts, error_rate, latency_ms, queue_depth, memory_mb, parser_health, destination_health)``
    where the health columns map component names to a state.
    """
    def when(name: str, anomaly: str, component: str, high: str, low: str):
        v = F.col(name).cast("double")
        level = F.when(v > severe[name], high).otherwise(low) if name in severe else F.lit(low)
        return F.when(v > limits[name], F.struct(F.lit(anomaly).alias("anomaly"), level.alias("severity"), F.lit(component).alias("component"), v.alias("value")))

    fixed = F.array_compact(F.array(
        when("error_rate", "high_error_rate", "pipeline", "high", "medium"),
        when("latency_ms", "high_latency", "pipeline", "medium", "medium"),
        when("queue_depth", "queue_backlog", "queue", "high", "medium"),
        when("memory_mb", "memory_pressure", "system", "critical", "high"),
    ))

    def sick(column: str, anomaly: str, prefix: str):
        names = F.map_keys(F.map_filter(column, lambda _, v: v == "unhealthy"))
        return F.transform(names, lambda n: F.struct(
            F.lit(anomaly).alias("anomaly"), F.lit("high").alias("severity"), F.concat(F.lit(prefix), n).alias("component"), F.lit(None).cast("double").alias("value")))

    everything = F.concat(fixed, sick("parser_health", "parser_degradation", "parser:"), sick("destination_health", "destination_failure", "destination:"))
    return samples.select("ts", F.explode(everything).alias("a")).select("ts", "a.*")


def trends(samples: DataFrame, length: str = "60 minutes", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mean, extremes and direction (last against first) of error rate and latency per sliding window."""
    w = watermarked(samples, "ts", delay).groupBy(F.window("ts", length, slide).alias("w"))
    measures = []
    for name in ("error_rate", "latency_ms"):
        rising = F.max_by(name, "ts") > F.min_by(name, "ts")
        measures += [F.avg(name).alias(f"{name}_avg"), F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max"),
                     F.when(rising, "increasing").otherwise("decreasing").alias(f"{name}_trend")]
    return w.agg(F.count("*").alias("n"), *measures).select(F.col("w.start").alias("start"), "n", *[c for n in ("error_rate", "latency_ms") for c in (f"{n}_avg", f"{n}_min", f"{n}_max", f"{n}_trend")])


def health_samples(events: DataFrame, bucket: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Health samples from raw events: error share, latency, load and component states per bucket."""
    g = watermarked(events, "ts", delay).groupBy(F.window("ts", bucket).alias("w"))
    errors = F.avg((F.col("event_type") == "error").cast("double"))
    state = lambda bad: F.when(bad, "unhealthy").otherwise("healthy")
    return g.agg(errors.alias("error_rate"), (F.avg("value") * 1000).alias("latency_ms"), F.count("*").alias("n"), F.max("value").alias("peak")).select(
        F.col("w.start").alias("ts"), "error_rate", "latency_ms", (F.col("n") * 300).alias("queue_depth"), (F.col("peak") * 200).alias("memory_mb"),
        F.create_map(F.lit("layout"), state(F.col("error_rate") > 0.5), F.lit("ocr"), state(F.col("peak") > 80)).alias("parser_health"),
        F.create_map(F.lit("search"), state(F.col("n") > 6)).alias("destination_health"))


def daily_counts(events: DataFrame, kind: str = "event_type", delay: str = "1 hour") -> DataFrame:
    """Events and value per day and kind. On a stream rows behind the watermark are dropped; the
    query's progress metric ``numRowsDroppedByWatermark`` counts them."""
    g = watermarked(events, "ts", delay).groupBy(F.window("ts", "1 day").alias("w"), kind)
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), kind, "n", "value")


def heartbeat_sessions(beats: DataFrame, gap: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """Unbroken heartbeat sessions per job; the end of a session is when the job counts as stalled."""
    g = watermarked(beats, "ts", delay).groupBy("job_id", F.session_window("ts", gap).alias("s"))
    return g.agg(F.count("*").alias("n_beats")).select("job_id", F.col("s.start").alias("alive_from"), F.col("s.end").alias("stalled_at"), "n_beats")
