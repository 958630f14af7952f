"""Continuous ingest, notification feeds and running streams to tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, quality, sinks
from docloom.session import shared_dir
from docloom.sources.files import mime_type

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

NOTIFICATION = (
    "Records array<struct<eventName:string,s3:struct<bucket:struct<name:string>,object:struct<key:string,size:long,eTag:string>>>>"
)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table as a file stream. Like a batch read, it takes a single file and a folder of part files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # Only a path with a glob may name a file; a plain one has to be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def new_folder(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), "docloom", f"{label}-{uuid.uuid4().hex}")


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all available input into a Parquet table and read the table."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = new_folder(spark, label)
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def new_objects(notifications: DataFrame) -> DataFrame:
    """Created objects from storage notifications, one row per file with its decoded key.

    ``notifications(value)`` holds one JSON document per row, batch or stream.
    """
    records = notifications.select(F.explode(F.from_json("value", NOTIFICATION)["Records"]).alias("r"))
    key = F.try_url_decode("r.s3.object.key")
    created = F.contains("r.eventName", F.lit("ObjectCreated")) & (F.col("r.s3.object.key") != "")
    return records.where(created).select(
        key.alias("path"), F.regexp_extract(key, r"([^/]+)$", 1).alias("name"), F.col("r.s3.object.size").alias("size"),
        mime_type(key).alias("mime_type"), F.regexp_replace("r.s3.object.eTag", '^"|"$', "").alias("etag"),
        F.col("r.eventName").alias("event"), F.col("r.s3.bucket.name").alias("bucket"))


def ingest_chunks(documents: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks with their quality, ready for the upsert."""
    chunks = chunking.fixed_windows(documents, size, overlap, carry=["lang"])
    scored = quality.text_quality(chunks, "content")
    return scored.select(
        F.col("doc_id").alias("job_id"), "chunk_index", "lang", "content", "content_hash", F.col("tq.score").alias("quality_score"))


def continuous_ingest(documents: DataFrame, table: str, checkpoint: str, remember: str = "7 days"):
    """Fingerprint, drop repeats seen within ``remember``, chunk, score and upsert every micro-batch.

    The upsert is keyed, so a batch that is replayed after a failure changes nothing. Returns the
    started query.
    """
    arrived = documents.withColumn("fingerprint", F.sha2("text", 256)).withColumn("arrived_at", F.current_timestamp())
    fresh = arrived.withWatermark("arrived_at", remember).dropDuplicatesWithinWatermark(["fingerprint"]).drop("fingerprint", "arrived_at")

    def upsert(batch: DataFrame, _: int) -> None:
        sinks.upsert_table(batch.sparkSession, table, ingest_chunks(batch), ["job_id", "chunk_index"], ["lang", "content", "content_hash", "quality_score"], replace=["job_id"])

    return fresh.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
