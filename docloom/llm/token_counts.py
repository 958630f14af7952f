"""Token counts through a table of counts kept by content digest and tokenizer version."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import base

COUNTS = "digest STRING, tokenizer STRING, n_tokens LONG"


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


#: A single space between two other characters always begins a token of a byte-level tokenizer.
_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def _counter(path: str):
    """Counts tokens of a text piece by piece. Pieces begin at single spaces, where tokens begin too."""
    import os

    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    first = base.Remembered(lambda piece: len(tokenizer.encode(piece, add_special_tokens=False).ids))
    later = base.Remembered(lambda piece: first.work(" " + piece))

    def count(text: str) -> int:
        if "  " not in text and text[:1] != " " and text[-1:] != " " and not _ODD.search(text):
            parts = text.split(" ")
            return first[parts[0]] + sum(map(later.__getitem__, parts[1:]))
        return sum(map(first.__getitem__, _CUT.split(text)))

    return count


#: A space beside other white space is part of a run, which is not cut.
_ODD = re.compile(r"\s \S|\S \s|\s\s \s?", re.UNICODE)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest; empty if there is no cache yet."""
    if not base.exists(spark, path):
        return spark.createDataFrame([], COUNTS)
    return (spark.read.schema(COUNTS).parquet(path).where(F.col("tokenizer") == version)
            .groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(df: DataFrame, tokenizer: str, cache: str, keep: list[str], text: Column | None = None) -> DataFrame:
    """Per row the columns ``keep``, ``n_bytes`` (UTF-8) and ``n_tokens``.

    Content is normalised no further than null to empty, since any other change could change the
    count. Texts are hashed where they lie. Digests that ``cache`` (a folder) holds for this
    tokenizer version are not encoded; of the others each distinct text is encoded once and its
    count appended. Copies meet in a partial aggregation, so a text that a third of the rows share
    is sent once per task. Repeated rows stay repeated; an empty table gives an empty one.
    """
    spark = df.sparkSession
    version = tokenizer_version(tokenizer)
    content = base.whole(F.col("text") if text is None else text)
    rows = df.select(*keep, content.alias("_text")).select(
        *keep, F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("_digest"), "_text")
    known = base.exists(spark, cache)
    missing = rows.select("_digest", "_text")
    if known:
        missing = missing.join(read_cache(spark, cache, version).select(F.col("digest").alias("_digest")), "_digest", "left_anti")
    distinct = missing.groupBy("_digest").agg(F.first("_text").alias("_text"))

    def encode(batch):
        count = _counter(tokenizer)
        yield {"digest": batch["_digest"], "tokenizer": [version] * len(batch["_digest"]), "n_tokens": [count(t) for t in batch["_text"]]}

    base.per_batch(distinct, encode, COUNTS).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version).select(F.col("digest").alias("_digest"), "n_tokens")
    return rows.drop("_text").join(counts, "_digest", "left").drop("_digest")
