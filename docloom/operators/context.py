"""Context around chunks, listings, duplicates and query caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import vector_cells


def window_context(chunks: DataFrame, width: int = 1, cut: int = 200) -> DataFrame:
    """Neighbouring chunk texts of the same document, each cut, joined with a blank.

    One window pass for all chunks; NULL where a side has no neighbour.
    """
    piece = F.left(F.col("content"), F.lit(cut))
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = F.collect_list(piece).over(order.rowsBetween(-width, -1))
    after = F.collect_list(piece).over(order.rowsBetween(1, width))
    none = F.lit(None).cast("string")
    return chunks.withColumn("previous", F.when(F.size(before) > 0, F.array_join(before, " ")).otherwise(none)).withColumn(
        "next", F.when(F.size(after) > 0, F.array_join(after, " ")).otherwise(none))


def format_window(content: Column, previous: Column, following: Column, cut: int = 100, separator: str = " | ") -> Column:
    """``[Prev: …] | content | [Next: …]`` with long neighbours shown shortened."""
    shown = lambda c: F.when(F.length(c) > cut, F.concat(F.left(c, F.lit(cut)), F.lit("..."))).otherwise(c)
    return F.concat_ws(
        separator,
        F.concat(F.lit("[Prev: "), shown(previous), F.lit("]")),
        content,
        F.concat(F.lit("[Next: "), shown(following), F.lit("]")),
    )


def parent_context(content: Column, title: Column, headers: Column, metadata: list[tuple[str, Column]]) -> Column:
    """Document title, indented section headers, selected metadata, then the content."""
    sections = F.array_join(
        F.transform(headers, lambda h, i: F.concat(F.repeat(F.lit("  "), i), F.lit("Section: "), h)), "\n")
    meta = F.concat_ws(" | ", *[F.concat(F.lit(f"{name.capitalize()}: "), value) for name, value in metadata])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Document: "), title),
        F.nullif(sections, F.lit("")),
        F.nullif(meta, F.lit("")),
        F.concat(F.lit("Content: "), content),
    )


def hierarchy_context(chunks: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Path from the hierarchy table, else from the chunk's own metadata.

    ``chunks(doc_id, chunk_index, content, title, own_path)``,
    ``hierarchy(doc_id, chunk_index, path, level)``; paths are string arrays.
    """
    joined = chunks.join(hierarchy, ["doc_id", "chunk_index"], "left")
    path = F.coalesce("path", "own_path")
    level = F.coalesce(F.col("level"), F.when(F.col("own_path").isNotNull(), F.size("own_path")))
    return joined.withColumn("path_text", F.array_join(path, " > ")).withColumn(
        "context",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Document: "), F.col("title")),
            F.concat(F.lit("Path: "), F.col("path_text")),
            F.concat(F.lit("Level: "), level.cast("string")),
            F.concat(F.lit("Content: "), F.col("content")),
        ),
    )


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page of a listing with the total next to every row."""
    total = rows.agg(F.count("*").alias("n")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def duplicate_groups(rows: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """Hashes that occur more than once, with the first row in creation order as the keeper."""
    return rows.groupBy(hash_col).agg(
        F.count("*").alias("n_copies"), F.min(order_col).alias("keeper"), F.max(order_col).alias("latest"),
    ).where(F.col("n_copies") > 1)


def cache_lookup(queries: DataFrame, cache: DataFrame, now: Column, min_similarity: float = 0.95) -> DataFrame:
    """Exact hit by hash, else the nearest cached vector above the floor, else a miss.

    ``queries(query_id, query_hash, query_vec)``; ``cache(cache_id, query_hash, vec, created_at,
    ttl_seconds)``. Expired entries never hit. Queries and entries meet in cells around pivots, where the floor bounds what is compared.
    """
    live = cache.where(F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("ttl_seconds")) > now)
    exact_by_hash = live.groupBy("query_hash").agg(F.min("cache_id").alias("exact_id"))
    looked = queries.join(exact_by_hash, "query_hash", "left")
    rest = looked.where(F.col("exact_id").isNull()).select("query_id", "query_vec")
    near = vector_cells.top_k(rest, live.select(F.col("cache_id").alias("id"), "vec"), 1, min_similarity)
    return looked.join(near.select("query_id", F.col("id").alias("near_id"), "similarity"), "query_id", "left").select(
        "query_id",
        F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "semantic").otherwise("miss").alias("layer"),
        F.coalesce("exact_id", "near_id").alias("cache_id"),
        F.when(F.col("exact_id").isNull(), F.col("similarity")).alias("similarity"),
    )


def cache_statistics(lookups: DataFrame) -> DataFrame:
    """Lookups, share and mean latency per layer, and for all (a running mean equals the mean)."""
    return lookups.rollup("layer").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("layer") != "miss").alias("hits"),
        F.round(F.avg((F.col("layer") != "miss").cast("double")), 6).alias("hit_rate"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    ).withColumn("layer", F.coalesce("layer", F.lit("all")))
