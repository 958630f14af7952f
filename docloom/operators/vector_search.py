"""Batches of vector queries against a vector table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Query components that one broadcast block holds, and scores that a task holds at once.
BLOCK_FLOATS, SCORE_CELLS = 4_000_000, 4_000_000


def checked_k(k: int, max_k: int | None) -> int:
    """``k``, or an error where it exceeds a limit that the caller has set; it is never lowered silently."""
    if max_k is not None and k > max_k:
        raise ValueError(f"k = {k} is more than max_k = {max_k}")
    return k


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


class Best:
    """The k best (query, id) pairs so far, smaller id first on equal scores. Ids may be of any ordered type."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.ids, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, first_query: int) -> None:
        """``scores`` and ``allowed`` are (row, query); query columns are numbered from ``first_query``."""
        if not scores.size:
            return
        if len(scores) > self.k:
            # All at or above the k-th value of a query compete, so ties are decided by id alone.
            shown = np.where(allowed, scores, -np.inf)
            allowed = allowed & (shown >= np.partition(shown, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, column = np.nonzero(allowed)
        self.merge(column + first_query, ids[row], scores[row, column])

    def merge(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """More pairs with their scores; of these and those so far the best stay."""
        query = np.concatenate([self.query, query])
        found = ids if self.ids is None else np.concatenate([self.ids, ids])
        score = np.concatenate([self.score, score])
        rank_of_id = np.unique(found, return_inverse=True)[1]
        order = np.lexsort((rank_of_id, -score, query))
        query = query[order]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        kept = order[place < self.k]
        self.query, self.ids, self.score = query[place < self.k], found[kept], score[kept]

    def batch(self, query_ids: np.ndarray, types: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
        if len(self.query):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[self.query], types[0]), pa.array(self.ids, types[1]), pa.array(self.score, pa.float64())], names=["query_id", "id", "similarity"])


def id_types(queries: DataFrame, rows: DataFrame, row_id: str):
    """Schema of results and the Arrow types of both ids."""
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", rows.schema[row_id].dataType), T.StructField("similarity", T.DoubleType())]
    return T.StructType(fields), (to_arrow_type(fields[0].dataType), to_arrow_type(fields[1].dataType))


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    min_similarity: float | None = 0.7,
    exclude_self: bool = False,
    block_floats: int = BLOCK_FLOATS,
    score_cells: int = SCORE_CELLS,
    max_k: int | None = None,
) -> DataFrame:
    """Exact top-k by cosine for every query.

    ``queries(query_id, query_vec)``, ``vectors(id, vec)`` with ids of any type; NULL vectors are
    skipped, and a query meets only vectors of its own length. Queries of at most ``block_floats``
    components go out to the vectors, which stay where they are; more queries than that are dealt to
    cells together with the vectors. A task scores at most ``score_cells`` pairs at once, and k rows
    per query leave it.
    """
    from docloom.operators import vector_cells

    k = checked_k(k, max_k)
    vectors = vectors.where(F.col("vec").isNotNull()).select("id", "vec")
    queries = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec").withColumn("_d", F.size("query_vec"))
    local = None
    for d, n in sorted((r["_d"], r["n"]) for r in queries.groupBy("_d").agg(F.count("*").alias("n")).collect()):
        some, rows = queries.where(F.col("_d") == d), vectors.where(F.size("vec") == d)
        if n * d <= block_floats:
            found = _scan(some, rows, k, min_similarity, exclude_self, score_cells)
        else:
            found = vector_cells.within(some, rows, k, min_similarity, exclude_self)
        local = found if local is None else local.unionByName(found)
    if local is None:
        local = queries.sparkSession.createDataFrame([], id_types(queries, vectors, "id")[0])
    return best_of(local, k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of ``(query_id, id, similarity)`` per query with their rank, similarities held within 0 and 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))))


def _scan(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None, skip_self: bool, cells: int) -> DataFrame:
    """One block of queries against all vectors."""
    schema, types = id_types(queries, vectors, "id")
    block = queries.toPandas()  # at most block_floats components
    query_ids = block["query_id"].to_numpy()
    unit_queries = _unit(np.array(block["query_vec"].tolist(), dtype=np.float64)) if len(block) else np.zeros((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, unit_queries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, unit_q = shared.value
        best = Best(k)
        for batch in batches:
            if batch.num_rows == 0 or len(ids_q) == 0:
                continue
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            unit_v, ids = _unit(flat.reshape(batch.num_rows, -1)), batch.column("id").to_numpy(zero_copy_only=False)
            width = max(1, cells // batch.num_rows)
            for lo in range(0, len(ids_q), width):
                sims = np.round(unit_v @ unit_q[lo:lo + width].T, 7)
                allowed = np.ones(sims.shape, bool) if floor is None else sims >= floor
                if skip_self:
                    allowed &= ids[:, None] != ids_q[None, lo:lo + width]
                best.add(sims, ids, allowed, lo)
        yield from best.batch(ids_q, types)

    return vectors.mapInArrow(scan, schema)


def filtered(
    vectors: DataFrame,
    metadata: dict[str, str] | None = None,
    chunk_index: int | None = None,
    content_hash: str | None = None,
    min_quality: float | None = None,
    extra: Column | None = None,
    model: str | None = None,
) -> DataFrame:
    """Filters that apply before scoring, so the limit counts only rows that pass."""
    out = vectors
    for key, value in (metadata or {}).items():
        out = out.where(F.col("metadata")[key] == value)
    if chunk_index is not None:
        out = out.where(F.col("chunk_index") == chunk_index)
    if content_hash is not None:
        out = out.where(F.col("content_hash") == content_hash)
    if min_quality is not None:
        out = out.where(F.col("quality_score") >= min_quality)
    if model is not None:
        out = out.where(F.col("model_name") == model)
    return out.where(extra) if extra is not None else out


def similar_to(seeds: DataFrame, vectors: DataFrame, k: int = 10, exclude_self: bool = True, max_k: int | None = None) -> DataFrame:
    """The k nearest neighbours of existing rows, without a threshold."""
    return top_k(seeds, vectors, k, min_similarity=None, exclude_self=exclude_self, max_k=max_k)


def validate(vectors: DataFrame, dims: int, column: str = "vec") -> DataFrame:
    """The first problem of every vector: missing, empty, wrong dimension, non-finite, or ok."""
    v = F.col(column)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    problem = (
        F.when(v.isNull(), "missing").when(F.size(v) == 0, "empty").when(F.size(v) != dims, "wrong_dimension")
        .when(bad, "not_finite").otherwise("ok")
    )
    return vectors.withColumn("problem", problem)


def sparse_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Cosine over sparse maps ``sparse`` (dimension → weight): an equi-join on the dimension.

    Weights are normalised first, so the score is one partial-aggregated sum per pair.
    """
    unit = lambda df, key: df.select(key, F.explode("sparse").alias("dim", "w"), F.sqrt(
        F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda acc, x: acc + x * x)).alias("len")
    ).where(F.col("len") > 0).select(key, "dim", (F.col("w") / F.col("len")).alias("w"))
    q = unit(queries, "query_id").withColumnRenamed("w", "qw")
    v = unit(vectors, "id")
    scores = v.join(q, "dim").groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 7).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
