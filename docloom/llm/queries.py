"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import base, merkle_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors by cosine for every fiftieth vector."""
    from docloom.llm import ann

    return ann.nearest(base.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 5, 50)


@query
def op2_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by weighted clauses, with what insults weigh learned from two thirds of the labels."""
    from docloom.llm import toxicity

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = base.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(~held_out)
    lexicon = toxicity.learn(docs, labels, "doc_id")
    return toxicity.score(docs, lexicon, ["doc_id"]).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "clauses")


@query
def op3_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 and more."""
    from docloom.llm import ngram_join

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_join.linked_components(docs, ngram_join.Rule(3, 90, 100))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op4_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. A source stands for an owner, a document for a repository."""
    from docloom.llm import secrets

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.find(docs, ["doc_id"], ["source"], ["doc_id"])
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(secrets.all_spans()).alias("spans"),
                        F.size("live").cast("long").alias("n_live"),
                        F.size(F.filter("repositories", lambda n: n > 1)).cast("long").alias("n_shared"))


@query
def op5_column_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that start in an earlier document too."""
    import hashlib

    from docloom.llm import suffix_dedup

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(text, removed):
        b = text.encode()
        return len(b), sum(e - s for s, e in removed), len(removed), hashlib.sha256(suffix_dedup.kept_bytes(b, removed)).hexdigest()

    return suffix_dedup.with_removals(docs, digest, "n_bytes LONG, n_removed LONG, n_spans LONG, kept_sha256 STRING", ["doc_id"])


@query
def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of nearly equal bytes."""
    from docloom.llm import sharding

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", sharding.text_size(F.col("text")).alias("_size"), F.crc32(base.whole(F.col("text")).cast("binary")).alias("text_crc32"))
    sharded = sharding.byte_shards(rows, ["doc_id", "text_crc32"], F.col("_size"), 24)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest integer inner products for every fiftieth vector."""
    from docloom.llm import topk

    return topk.top_k(base.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 5, 50)


SQL["op7_block_top_k"] = """
WITH rows AS (
    SELECT vec_id, MIN(embedding) AS embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    GROUP BY vec_id),
whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM rows),
scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.w, d.w)::BIGINT AS score
    FROM whole q JOIN whole d ON q.vec_id <> d.vec_id AND len(q.w) = len(d.w) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 5
"""


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a digest cache that this run begins empty."""
    from docloom.llm import token_counts

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), base.work_path(spark, "token-cache"), ["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op9_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    from docloom.llm import packing

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = base.stored(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), 4096, ["doc_id"]), "pieces")
    packed = packing.pack(pieces, 4096, ["doc_id", "piece", "ids_crc32"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    from docloom.llm import byte_bpe

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"]).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op11_dawg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after known damage: its faults and the cheapest edits that make it well formed."""
    from docloom.llm import conversations

    turns = base.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damage(turns), every=turns)


@query
def op12_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of the same text that stays, the one of the largest id."""
    from docloom.llm import exact_dedup

    return exact_dedup.duplicates(base.table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op12_extendible_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, folded again with texts of a fifth of the ids lower-cased."""
    from docloom.llm import merkle

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": F.when(touched, lower).otherwise(F.col("text"))})


SQL["op13_merkle_manifest"] = merkle_sql.SQL
