"""Approximate nearest neighbours: a forest of random-projection trees under one priority queue per query."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import base, vectors

#: The trees are fitted on about this many vectors, chosen by hash; every vector is indexed.
SAMPLE = 50_000
TREES = 16
#: Sample vectors of a leaf; vectors of an index cell (fuller leaves are split); queries of a cell.
LEAF, CELL_ROWS, CELL_QUERIES = 1024, 4096, 4096
#: Share of the sample's true neighbours that the search effort is set for.
TARGET, TUNED_ON = 0.96, 300


class Forest:
    """Full binary trees in arrays: node n of a tree has children 2n + 1 and 2n + 2."""

    def __init__(self, unit: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = max(0, round(np.log2(max(1, len(unit) / leaf))))
        self.leaves, inner, dims = 2**self.depth, 2**self.depth - 1, unit.shape[1]
        self.normals = np.zeros((trees, inner, dims), np.float32)
        self.cuts = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            members = {0: np.arange(len(unit))}
            for n in range(inner):
                own = members.pop(n)
                if len(own) > 1:
                    a, b = unit[rng.choice(own, 2, replace=False)]
                    normal = a - b
                else:
                    normal = np.zeros(dims)
                length = np.linalg.norm(normal)
                normal = normal / length if length else rng.standard_normal(dims) / np.sqrt(dims)
                along = unit[own] @ normal
                self.normals[t, n], self.cuts[t, n] = normal, np.median(along) if len(own) else 0
                right = along > self.cuts[t, n]
                members[2 * n + 1], members[2 * n + 2] = own[~right], own[right]
        self.share = np.full(trees * self.leaves, 1.0 / self.leaves)

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through: tree * leaves + leaf."""
        out = np.zeros((len(unit), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", unit, self.normals[t, node])
                node = 2 * node + 1 + (along > self.cuts[t, node])
            out[:, t] = t * self.leaves + node - (self.leaves - 1)
        return out

    def visits(self, unit: np.ndarray, effort: float):
        """Per query the leaves of all trees, best first, until they hold ``effort`` of the vectors.

        One queue serves all trees. A node's priority is the least signed distance to the planes on
        its way: positive on the query's own side, negative beyond a plane.
        """
        margins = [unit @ normals.T - cuts for normals, cuts in zip(self.normals, self.cuts, strict=True)]
        inner = self.leaves - 1
        for i in range(len(unit)):
            queue = [(-np.inf, t, 0) for t in range(len(margins))]
            heapq.heapify(queue)
            got, seen = [], 0.0
            while queue and seen < effort:
                cost, t, node = heapq.heappop(queue)
                if node >= inner:
                    leaf = t * self.leaves + node - inner
                    got.append(leaf)
                    seen += self.share[leaf]
                    continue
                m = float(margins[t][i, node])
                heapq.heappush(queue, (max(cost, m), t, 2 * node + 1))
                heapq.heappush(queue, (max(cost, -m), t, 2 * node + 2))
            yield got


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def needed_effort(forest: Forest, unit: np.ndarray, k: int) -> float:
    """The share of all vectors to look at (over all trees) that finds TARGET of the sample's true neighbours."""
    if len(unit) <= k + 1 or forest.depth == 0:
        return float(len(forest.normals))
    asked = np.linspace(0, len(unit) - 1, min(TUNED_ON, len(unit)), dtype=int)
    leaf_of = forest.assign(unit)
    need = []
    for lo in range(0, len(asked), 50):
        some = asked[lo:lo + 50]
        near = unit[some] @ unit.T
        near[np.arange(len(some)), some] = -2
        best = np.argpartition(-near, k, axis=1)[:, :k]
        for q, visited in enumerate(forest.visits(unit[some], np.inf)):
            cost = np.full(len(forest.share), np.inf)
            cost[visited] = np.cumsum(forest.share[visited])
            need.extend(cost[leaf_of[best[q]]].min(axis=1))
    return float(np.quantile(need, TARGET))


def _search_cells(ids, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """The k best of a cell for each query by exact cosine in double precision, own row aside."""
    v, q = v.astype(np.float64), q.astype(np.float64)
    v_len, q_len = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    first = np.array([i[0] for i in ids])
    out = []
    for lo in range(0, len(q), 512):
        part = q[lo:lo + 512] @ v.T / v_len / q_len[lo:lo + 512, None]
        # All at or near the (k + 1)-th value compete (one may be the query's own row), so equal scores are decided by id alone.
        take = min(len(v), k + 1)
        least = np.partition(part, len(v) - take, axis=1)[:, len(v) - take] - 1e-9
        for j in range(len(part)):
            candidates = np.flatnonzero(part[j] >= least[j])
            a, own = lo + j, int(query_ids[lo + j])
            exact = (v[candidates] * q[a]).sum(axis=1) / (v_len[candidates] * q_len[a])
            rows = []
            for c in np.lexsort((first[candidates], -exact)):
                rows.extend((own, int(i), float(exact[c])) for i in ids[candidates[c]] if i != own)
            rows.sort(key=lambda r: (-r[2], r[1]))
            out.extend(rows[:k])
    return out


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int, query_every: int, trees: int = TREES, effort: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``query_every`` divides, the ``k`` nearest found by cosine.

    Equal vectors are indexed once with their k + 1 smallest ids, which is all that a top k can
    show of them. Each distinct vector goes to one leaf of every tree. A query goes to the leaves
    that its queue names and gets the exact best k of each; these are merged. Leaves fuller than
    CELL_ROWS are split, and so are queries, so no cell is unbounded. ``effort`` (share of all
    vectors, summed over trees) is measured on the sample unless given. Zero vectors and those with
    null or non-finite components take no part; vectors of different length are not compared.
    """
    spark = df.sparkSession
    nonzero = vectors.one_per_id(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    usable = base.stored(nonzero.withColumn("dim", F.size("vec")), "vectors")
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    distinct = usable.withColumn("_place", place).where(F.col("_place") <= k + 1).groupBy("dim", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    found = None
    for dim, total in sorted((r[0], r[1]) for r in usable.groupBy("dim").count().collect()):
        one = _of_dimension(usable.where(F.col("dim") == dim), distinct.where(F.col("dim") == dim), total, k, query_every, trees, effort)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id LONG, rank INT, vec_id LONG, score DOUBLE")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_dimension(usable: DataFrame, distinct: DataFrame, total: int, k: int, every: int, trees: int, effort: float | None) -> DataFrame:
    spark = usable.sparkSession
    dtype = "<f4" if dict(usable.dtypes)["vec"] == "array<float>" else "<f8"

    def pack(batches):
        for batch in batches:
            blobs = [np.array(v, dtype).tobytes() for v in batch.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], names=["id", "v"])

    # A share of about SAMPLE rows, chosen by a hash of the vector: the same rows in every run.
    grain = 1_000_000
    chosen = F.pmod(F.xxhash64("vec"), F.lit(grain)) < F.lit(max(1, min(grain, SAMPLE * grain // max(1, total))))
    sample = distinct.where(chosen).select(F.element_at("ids", 1).alias("id"), "vec").mapInArrow(pack, "id LONG, v BINARY").limit(2 * SAMPLE).toPandas().sort_values("id")
    unit = unit_rows(vectors.matrix(list(sample["v"]), dtype)) if len(sample) else np.zeros((1, 1), np.float32)
    forest = Forest(unit, trees, LEAF)
    forest.share = np.bincount(forest.assign(unit).ravel(), minlength=trees * forest.leaves) / max(1, len(unit))
    effort = needed_effort(forest, unit, k) if effort is None else effort
    shared = spark.sparkContext.broadcast(forest)  # bounded: trees * SAMPLE / LEAF planes

    def index(batches):
        for batch in batches:
            rows = np.array(batch.column("vec").to_pylist(), dtype)
            if not len(rows):
                continue
            cells, blobs = shared.value.assign(unit_rows(rows)), [r.tobytes() for r in rows]
            for t in range(cells.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, t]), batch.column("ids"), pa.array(blobs, pa.binary())], names=["cell", "ids", "v"])

    def route(batches):
        for batch in batches:
            rows = np.array(batch.column("vec").to_pylist(), dtype)
            if not len(rows):
                continue
            for row, qid, cells in zip(rows, batch.column("id").to_pylist(), shared.value.visits(unit_rows(rows), effort), strict=True):
                n = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([qid] * n, pa.int64()), pa.array([row.tobytes()] * n, pa.binary())], names=["cell", "query_id", "q"])

    indexed = base.stored(distinct.select("ids", "vec").mapInArrow(index, "cell LONG, ids ARRAY<LONG>, v BINARY"), "forest")
    asks = usable.where(F.col("id") % every == 0).select("id", "vec")
    parts = max(1, -(-asks.count() // CELL_QUERIES))
    # One row per leaf of the forest, so bounded like the forest itself.
    pages = {r[0]: -(-r[1] // CELL_ROWS) for r in indexed.groupBy("cell").count().collect()}
    paged = spark.createDataFrame(list(pages.items()) or [(-1, 1)], "cell LONG, pages INT")
    rows = (indexed.join(F.broadcast(paged), "cell").withColumn("page", F.pmod(F.xxhash64("ids"), F.col("pages")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("cell", "page", "part", "ids", "v"))
    queries = (asks.mapInArrow(route, "cell LONG, query_id LONG, q BINARY").join(F.broadcast(paged), "cell")
               .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
               .withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).select("cell", "page", "part", "query_id", "q"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = _search_cells(list(b["ids"]), vectors.matrix(list(b["v"]), dtype), a["query_id"].to_numpy(), vectors.matrix(list(a["q"]), dtype), k) if len(a) and len(b) else []
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["cell", "page", "part"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(search, "query_id LONG, vec_id LONG, score DOUBLE")
