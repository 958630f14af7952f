"""Embedding worklists, hash embeddings, quantisation and reduction."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_DIMS = 384

# Terms that mark a technical text; two of them make it technical.
TECHNICAL_TERMS = [
    "api", "function", "class", "method", "parameter", "configuration", "implementation",
    "algorithm", "database", "query", "server", "client", "framework", "library", "module",
    "package", "syntax", "compiler", "runtime", "debug", "architecture", "protocol", "interface",
]


class RunningEmbedding:
    """The hash embedding of a growing text: word i adds its 16 MD5 bytes (as 0..1) from slot 16·i on, modulo 384."""

    def __init__(self) -> None:
        self.total, self.words = np.zeros(HASH_DIMS), 0

    def add(self, text: str) -> None:
        found = text.lower().split()
        if found:
            digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in found), dtype=np.uint8)
            lead = self.words * 16 % HASH_DIMS
            padded = np.zeros(-(-(lead + len(digests)) // HASH_DIMS) * HASH_DIMS)
            padded[lead:lead + len(digests)] = digests
            self.total += padded.reshape(-1, HASH_DIMS).sum(axis=0) / 255.0
            self.words += len(found)

    def unit(self) -> np.ndarray:
        length = np.linalg.norm(self.total)
        return self.total / length if length > 0 else self.total


def hash_embedding(text: str) -> np.ndarray:
    """Unit vector of the word hashes of a text."""
    whole = RunningEmbedding()
    whole.add(text)
    return whole.unit()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embed(text: pd.Series) -> pd.Series:
    """Arrow-batched slot for an embedder; the default is the deterministic hash embedding."""
    return text.fillna("").map(hash_embedding)


def cache_key(text: Column, model: str) -> Column:
    return F.sha2(F.concat(text, F.lit(":" + model)), 256)


def worklist(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts that are not in the cache yet, one row per key.

    Keys are reduced before the join, so a text repeated many times costs one row.
    """
    keyed = texts.select(cache_key(F.col("text"), model).alias("key"), "text")
    missing = keyed.groupBy("key").agg(F.min("text").alias("text"), F.count("*").alias("n_uses"))
    return missing.join(cache.select("key"), "key", "left_anti")


def embed_with_cache(texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[str], Column] = hash_embed) -> DataFrame:
    """All texts with their vector: cached where known, embedded once per distinct text where not.

    ``embed`` is a function of the text column. A NULL text keeps its row, without a vector or a hit.
    """
    fresh = worklist(texts, cache, model).where(F.col("key").isNotNull()).select("key", embed("text").alias("embedding"), F.lit(False).alias("hit"))
    known = cache.select("key", "embedding", F.lit(True).alias("hit"))
    keyed = texts.withColumn("key", cache_key(F.col("text"), model))
    return keyed.join(known.unionByName(fresh), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def quantise(df: DataFrame, column: str = "embedding") -> DataFrame:
    """8-bit codes with the vector's own range; a constant vector becomes zeros."""
    vec = F.transform(F.col(column), lambda x: x.cast("double"))
    lo, hi = F.array_min("_v"), F.array_max("_v")
    codes = F.transform(
        "_v",
        lambda x: F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
            F.floor((x - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 255.0).cast("int")
        ).cast("smallint"),
    )
    return df.withColumn("_v", vec).withColumn("lo", lo).withColumn("hi", hi).withColumn("codes", codes).drop("_v")


def dequantise(codes: Column, lo: Column, hi: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") / 255.0 * (hi - lo) + lo)


def reduce_dims(df: DataFrame, column: str = "embedding", target: int = 256, keep: float = 0.95):
    """Centre, project on the leading components and report how much variance they explain.

    Returns the reduced frame, the explained share and whether it reaches ``keep``.
    """
    dims = df.select(F.max(F.size(column)).alias("d")).first()["d"]
    k = min(target, dims - 1)
    vectors = df.withColumn("_raw", array_to_vector(F.transform(F.col(column), lambda x: x.cast("double"))))
    centre = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False).fit(vectors)
    centred = centre.transform(vectors)
    model = PCA(k=k, inputCol="_centred", outputCol="_reduced").fit(centred)
    explained = float(model.explainedVariance.toArray().sum())
    reduced = model.transform(centred).withColumn("reduced", vector_to_array("_reduced")).drop("_raw", "_centred", "_reduced")
    return reduced, explained, explained >= keep


def is_technical(text: Column) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in TECHNICAL_TERMS), F.lit(0)) >= 2


def choose_model(texts: DataFrame, batch: str) -> DataFrame:
    """One model per batch: technical when long and technical, large when very long, else small."""
    stats = texts.groupBy(batch).agg(
        F.count("*").alias("n_texts"),
        F.avg(F.length("text")).alias("mean_length"),
        F.bool_or(is_technical(F.col("text"))).alias("technical"),
    )
    model = (
        F.when(F.col("technical") & (F.col("mean_length") > 500), "technical")
        .when(F.col("mean_length") > 1000, "large")
        .otherwise("small")
    )
    return stats.withColumn("model", model)
