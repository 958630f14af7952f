"""Pattern entities, their deduplication and lookup."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entity patterns, matched without regard to case.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "url": r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[^\s]*",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b",
    "money": r"\$[\d,]+(?:\.\d{2})?|\b\d+\s*(?:USD|EUR|GBP)\b",
    "percent": r"\b\d+(?:\.\d+)?%",
}
CONFIDENCE = 0.9


def _matches(text: Column, pattern: str) -> Column:
    """All matches with offsets: a match starts where the gaps and matches before it end."""
    flagged = f"(?iU){pattern}"
    found = F.regexp_extract_all(text, F.lit(flagged), F.lit(0))
    gaps = F.split(text, flagged)
    folded = F.aggregate(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,stop:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.array_append(acc["out"], F.struct(
                x["hit"].alias("text"), (acc["at"] + F.length(x["gap"])).alias("start"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, folded).otherwise(F.array().cast("array<struct<text:string,start:int,stop:int>>"))


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """One row per match: ``(key, entity_type, entity_text, start_pos, end_pos, confidence)``."""
    by_type = F.array(*[
        F.struct(F.lit(kind).alias("kind"), _matches(F.col(text), pattern).alias("hits")) for kind, pattern in patterns.items()
    ])
    return docs.select(key, F.explode(by_type).alias("g")).select(key, F.col("g.kind").alias("entity_type"), F.explode("g.hits").alias("h")).select(
        key, "entity_type", F.col("h.text").alias("entity_text"), F.col("h.start").alias("start_pos"), F.col("h.stop").alias("end_pos"),
        F.lit(CONFIDENCE).alias("confidence"))


def deduplicate(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per (text without case and outer blanks, type): the most confident mention.

    Equal confidence keeps the first by ``key`` and position.
    """
    norm = F.lower(F.regexp_replace("entity_text", r"^\s+|\s+$", ""))
    best = F.struct(-F.col("confidence"), F.col(key), F.col("start_pos"))
    return entities.groupBy(norm.alias("entity"), "entity_type").agg(
        F.min_by(F.struct("entity_text", key, "confidence"), best).alias("b"), F.count("*").alias("n_mentions"),
    ).select("entity", "entity_type", "b.*", "n_mentions")


def find_chunks(entities: DataFrame, text: str, entity_type: str | None = None, key: str = "chunk_id") -> DataFrame:
    """Ids with an entity whose text contains ``text`` (any case) and, if given, has the type."""
    hit = F.contains(F.lower("entity_text"), F.lit(text.lower()))
    if entity_type:
        hit = hit & (F.col("entity_type") == entity_type)
    return entities.where(hit).select(key).distinct()
