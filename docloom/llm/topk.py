"""Exact top-k inner products over blocks of a document range, pruned by each block's term maxima."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import vectors

#: Vectors of a block, and vectors and queries of a cell, which is what one call holds.
BLOCK, CELL_ROWS, CELL_QUERIES = 256, 8192, 1024


def quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec: each component x becomes floor(256 * x), x as double."""
    rows = vectors.one_per_id(df, id_col, vec_col)
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def top_of_blocks(ids: np.ndarray, weights: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Best k (ids, scores) per query over all vectors but its own; ties to smaller ids. Also the share of blocks scored.

    Per query the blocks are visited by descending bound, the sum over terms of the larger of
    query weight times block maximum and times block minimum. A query ends at the first block
    whose bound is below its k-th score; a bound equal to it may still hide a smaller id.
    """
    n, q = len(ids), len(query_ids)
    exact_float = n == 0 or q == 0 or float(np.abs(weights).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, weights.shape[1]) < 2.0**53
    kind = np.float64 if exact_float else object  # products of whole numbers stay exact either way
    weights, queries = weights.astype(kind), queries.astype(kind)
    starts = list(range(0, n, BLOCK))
    high = np.array([weights[s:s + BLOCK].max(axis=0) for s in starts]).reshape(len(starts), -1)
    low = np.array([weights[s:s + BLOCK].min(axis=0) for s in starts]).reshape(len(starts), -1)
    bound = (np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T).astype(np.float64)
    slack = np.abs(bound) * 0 if exact_float else np.abs(bound) * 1e-9
    order = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).max
    best_ids = np.full((q, k), none, np.int64)
    best = np.full((q, k), -np.inf, kind)
    alive, scored = np.arange(q), 0
    for step in range(len(starts)):
        block = order[alive, step]
        reach = bound[alive, block] + slack[alive, block]
        keep = reach >= best[alive, k - 1].astype(np.float64)
        alive, block = alive[keep], block[keep]  # later bounds are no larger
        if not len(alive):
            break
        scored += len(alive)
        for b in np.unique(block):
            who = alive[block == b]
            at = slice(starts[b], starts[b] + BLOCK)
            score = queries[who] @ weights[at].T
            score = np.where(ids[at][None, :] == query_ids[who][:, None], -np.inf, score)
            all_scores = np.concatenate([best[who], score], axis=1)
            all_ids = np.concatenate([best_ids[who], np.broadcast_to(ids[at], score.shape)], axis=1)
            rank = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[who], best_ids[who] = np.take_along_axis(all_scores, rank, 1), np.take_along_axis(all_ids, rank, 1)
    return best_ids, best, scored / max(1, q * len(starts))


def top_k(df: DataFrame, id_col: str, vec_col: str, k: int, query_every: int) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of all rows for each row whose id ``query_every`` divides.

    Rows and queries meet in a grid of cells of bounded size; each cell returns k rows per query.
    Vectors are dealt by id range, so blocks are ranges of documents. Vectors of different length
    are not compared. An empty table gives an empty table.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vec_col).withColumn("dim", F.size("vec"))
    picked = rows.where(F.col("id") % query_every == 0)
    total, asked = rows.count(), picked.count()
    row_cells, query_cells = max(1, -(-total // CELL_ROWS)), max(1, -(-asked // CELL_QUERIES))
    packed = "id LONG, dim INT, w BINARY"

    def pack(batches):
        for batch in batches:
            blobs = [np.array(v, "<i8").tobytes() for v in batch.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dim"), pa.array(blobs, pa.binary())], names=["id", "dim", "w"])

    ranged = rows.repartitionByRange(row_cells, "id").mapInArrow(pack, packed).withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(row_cells)))
    docs = ranged.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1))))
    # Ranges of the sampled shuffle may be uneven, never unbounded; every range meets every query block.
    asks = (picked.mapInArrow(pack, packed).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(query_cells)).cast("int"))
            .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(row_cells - 1)))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64")})
        left = left.sort_values("id")
        q = right["id"].to_numpy()
        got, score, _ = top_of_blocks(left["id"].to_numpy(), vectors.matrix(list(left["w"]), "<i8"), q, vectors.matrix(list(right["w"]), "<i8"), k)
        some = score != -np.inf
        return pd.DataFrame({"query_id": np.repeat(q, k).reshape(-1, k)[some], "vec_id": got[some], "score": [int(x) for x in score[some]]})

    keys = ["dim", "cell", "part"]
    found = asks.groupBy(*keys).cogroup(docs.groupBy(*keys)).applyInPandas(lambda a, b: cell(b, a), "query_id LONG, vec_id LONG, score LONG")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
