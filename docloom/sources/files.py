"""File listings, fingerprints and type inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension, content type, recommended parser, confidence.
FILE_TYPES = [
    (".docx", "office_doc", "layout", 0.95),
    (".doc", "office_doc", "layout", 0.90),
    (".xlsx", "office_spreadsheet", "layout", 0.95),
    (".xls", "office_spreadsheet", "layout", 0.90),
    (".pptx", "office_presentation", "layout", 0.95),
    (".ppt", "office_presentation", "layout", 0.90),
    (".jpg", "image", "ocr", 0.95),
    (".jpeg", "image", "ocr", 0.95),
    (".png", "image", "ocr", 0.95),
    (".tiff", "image", "ocr", 0.90),
    (".tif", "image", "ocr", 0.90),
    (".bmp", "image", "ocr", 0.85),
    (".gif", "image", "ocr", 0.80),
    (".csv", "csv", "layout", 1.0),
    (".tsv", "csv", "layout", 1.0),
    (".json", "json", "layout", 1.0),
    (".jsonl", "json", "layout", 1.0),
    (".xml", "xml", "layout", 1.0),
    (".zip", "archive", "layout", 0.90),
]

# MIME type by extension for listings.
MIME_TYPES = {
    ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json", ".jsonl": "application/jsonl",
    ".xml": "application/xml", ".html": "text/html", ".txt": "text/plain", ".pdf": "application/pdf",
    ".zip": "application/zip", ".png": "image/png", ".jpg": "image/jpeg", ".parquet": "application/vnd.apache.parquet",
}


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


def list_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """Files under ``path`` with size, time and MIME type; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"),
        mime_type(F.col("path")).alias("mime_type"), F.col("modificationTime").alias("modified_at"))


def known_results(files: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Files with the id of an unexpired earlier result for the same bytes, if any.

    ``files(file_id, content)``, ``results(result_id, content_hash, expires_at)``.
    """
    live = results.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    by_hash = live.groupBy("content_hash").agg(F.max("result_id").alias("result_id"))
    hashed = files.withColumn("content_hash", F.sha2("content", 256)).drop("content")
    return hashed.join(by_hash, "content_hash", "left")


def access_counts(matched: DataFrame) -> DataFrame:
    """How often each earlier result was reused."""
    return matched.where(F.col("result_id").isNotNull()).groupBy("result_id").agg(F.count("*").alias("n_accesses"))


def type_inventory(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Files and bytes per content type and parser; unknown extensions stay as ``unknown``."""
    table = F.broadcast(files.sparkSession.createDataFrame(FILE_TYPES, "ext string, content_type string, parser string, confidence double"))
    typed = files.withColumn("ext", extension(F.col(path))).join(table, "ext", "left")
    return typed.groupBy(
        F.coalesce("content_type", F.lit("unknown")).alias("content_type"), F.coalesce("parser", F.lit("layout")).alias("parser"),
    ).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"), F.round(F.avg(F.coalesce("confidence", F.lit(0.5))), 6).alias("confidence"))
