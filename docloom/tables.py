"""Loaders for the input tables and for the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import store
from docloom.functions import text as tx
from docloom.operators import chunking, postings, text_search, vector_cells

# Every rule about age or expiry compares with this instant unless told otherwise.
FIXED_CLOCK = "2024-01-31 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, label: str, build) -> str:
    """The folder of a table derived from ``documents``, written where this state of them has none yet."""
    state, size = store.state_of(spark, f"{sf_dir}/documents.parquet")
    return store.once(spark, label, state, lambda path: build(path, size))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central chunk table: fixed windows of every document, cut once and dealt over many files."""

    def build(path: str, size: int) -> None:
        docs = load(spark, sf_dir, "documents")
        cut = chunking.fixed_windows(docs, carry=["lang", "source"]).withColumn("chunk_id", F.col("doc_id") * F.lit(1000000) + F.col("chunk_index"))
        cut.repartition(store.file_count(spark, size), F.xxhash64("chunk_id")).write.parquet(path)

    return spark.read.parquet(_derived(spark, sf_dir, "chunks", build))


def chunk_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The positional index over :func:`chunks`, built once."""
    return postings.open_index(spark, _derived(spark, sf_dir, f"postings-{postings.LAYOUT}", lambda path, size: postings.build(chunks(spark, sf_dir), path)))


def gram_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The index over the trigrams of :func:`chunks`, built once."""
    return postings.open_index(spark, _derived(spark, sf_dir, f"grams-{postings.LAYOUT}", lambda path, size: postings.build(
        chunks(spark, sf_dir), path, text_search.trigrams(F.col("content")))))


def vector_lists(spark: SparkSession, sf_dir: str) -> vector_cells.Lists:
    """Coded inverted lists over the embeddings, built once."""
    state, _ = store.state_of(spark, f"{sf_dir}/embeddings.parquet")
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).where("vec IS NOT NULL")
    return vector_cells.open_lists(spark, store.once(spark, "lists-1", state, lambda path: vector_cells.build_lists(rows, path)))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as term queries: every distinct non-stop word of the whole text."""
    items = load(spark, sf_dir, "benchmark")
    terms = F.array_except(
        F.array_distinct(tx.words(F.col("text"))),
        F.array(*[F.lit(w) for w in tx.ENGLISH_STOP_WORDS]),
    )
    return items.select(F.col("item_id").alias("query_id"), F.explode(terms).alias("term"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as vector queries: the vector that shares the item's id."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.join(items, "vec_id", "left_semi").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")
    )


def mentions_in(chunk_rows: DataFrame) -> DataFrame:
    """Entity mentions of type ``concept`` in ``chunk_rows(chunk_id, doc_id, content, ...)``; other columns are kept."""
    rest = [c for c in chunk_rows.columns if c not in ("chunk_id", "doc_id", "content")]
    words = F.array_except(F.array_distinct(tx.words(F.col("content"))), F.array(*[F.lit(w) for w in tx.ENGLISH_STOP_WORDS]))
    return chunk_rows.select("chunk_id", "doc_id", *rest, F.explode(words).alias("entity_text")).select(
        "chunk_id", "doc_id", "entity_text", F.lit("concept").alias("entity_type"), F.lit(0.6).alias("confidence"), *rest)


def concept_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity mentions of type ``concept``: every word but stop words, once per chunk, however common."""
    return mentions_in(chunks(spark, sf_dir).select("chunk_id", "doc_id", "content"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the vector of their document, NULL where the document has none."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    return chunks(spark, sf_dir).join(vectors, "doc_id", "left")
