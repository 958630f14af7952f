"""Vectors dealt into cells: exact search within a floor around pivots, and approximate search over coded lists.

Queries are rows like any other here: they are sent to the cells that they can find something in, and
nothing of them is collected. A cell is cut into pages of bounded size, so one dense region is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.operators import vector_search as vs

#: Pivots of an exact search; rows of a page; queries that are compared at once.
PIVOTS, PAGE_ROWS, TOGETHER = 16, 4096, 64
#: Rows that centroids and codes are fitted on, cells at most, bytes of a code and values of a byte.
SAMPLE_ROWS, MOST_CELLS, CODE_BYTES, CODE_VALUES = 20_000, 4096, 16, 256


def _matrix(column: pa.Array) -> np.ndarray:
    return vs._unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _pages(batches: Iterator[pa.RecordBatch], read, answer) -> Iterator[pa.RecordBatch]:
    """Rows sorted by page, held rows before asking ones: ``read`` makes a page of the former, ``answer`` takes batches of the latter."""
    current, held, page = None, [], None
    for batch in batches:
        numbers, asks = batch.column("page").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(int)
        cuts = np.flatnonzero(np.append(True, (np.diff(numbers) != 0) | (np.diff(asks) != 0))) if len(numbers) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(numbers)], strict=False):
            if numbers[lo] != current:
                current, held, page = numbers[lo], [], None
            if not asks[lo]:
                held.append(batch.slice(lo, hi - lo))
            elif held:
                page = page or read(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                yield from answer(page, batch.slice(lo, hi - lo))


def _to_pages(rows: DataFrame, asks: DataFrame) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    both = rows.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    return both.repartition(tasks, "page").sortWithinPartitions("page", "asks")


def within(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None, exclude_self: bool = False, pivots: int = PIVOTS, page_rows: int = PAGE_ROWS,
           count_pairs: bool = False) -> DataFrame:
    """Exact top-k by cosine of at least ``floor`` for any number of queries: ``(query_id, id, similarity)`` before the final cut.

    Rows lie in the cell of their nearest pivot, sorted by their angle to it. By the triangle
    inequality a row within the floor's angle t of a query lies in a cell whose pivot is no more than
    2 t farther from the query than its nearest one, and in the ring of t around the query's own
    angle. Only these are compared; without a floor that is everything. With ``count_pairs`` the
    similarity is replaced by how many rows of a page a query was compared with.
    """
    spark = vectors.sparkSession
    schema, types = vs.id_types(queries, vectors, "id")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], schema)
    # A bounded number of rows, whichever have the smallest hashes.
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").toArrow()["vec"].combine_chunks()
    centres = np.unique(_matrix(pa.concat_arrays(chosen.chunks) if isinstance(chosen, pa.ChunkedArray) else chosen), axis=0)
    reach = np.pi if floor is None else float(np.arccos(np.clip(floor - 1e-6, -1.0, 1.0)))
    pages = int(max(1, n // (page_rows * len(centres))))
    shared = spark.sparkContext.broadcast(centres)

    def cells_of_rows(batches):
        for batch in batches:
            unit = _matrix(batch.column("vec"))
            cell = _angles(unit, shared.value).argmin(axis=1) if len(unit) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    def cells_of_queries(batches):
        for batch in batches:
            unit = _matrix(batch.column("query_vec"))
            angle = _angles(unit, shared.value) if len(unit) else np.zeros((0, 1))
            able = angle <= angle.min(axis=1, keepdims=True) + 2 * reach
            cells = pa.array([np.flatnonzero(row).tolist() for row in able], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    rows = vectors.select("id", "vec").mapInArrow(cells_of_rows, T.StructType([*vectors.select("id", "vec").schema, T.StructField("cell", T.IntegerType())]))
    rows = rows.select((F.col("cell") * pages + F.pmod(F.xxhash64("id"), F.lit(pages))).cast("int").alias("page"), "id", "vec")
    asks = queries.select("query_id", "query_vec").mapInArrow(cells_of_queries, T.StructType([*queries.select("query_id", "query_vec").schema, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    asks = asks.select("query_id", "query_vec", F.explode("cells").alias("cell")).select("*", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("p"))
    asks = asks.select((F.col("cell") * pages + F.col("p")).cast("int").alias("page"), "query_id", "query_vec")

    def read(batch):
        unit = _matrix(batch.column("vec"))
        pivot = batch.column("page")[0].as_py() // pages
        angle = _angles(unit, shared.value[pivot:pivot + 1])[:, 0]
        order = np.argsort(angle, kind="stable")
        return batch.column("id").to_numpy(zero_copy_only=False)[order], unit[order], angle[order], pivot

    def answer(page, batch):
        ids, unit, angle, pivot = page
        q, query_ids = _matrix(batch.column("query_vec")), batch.column("query_id").to_numpy(zero_copy_only=False)
        own = _angles(q, shared.value[pivot:pivot + 1])[:, 0]
        best, order, compared = vs.Best(k), np.argsort(own, kind="stable"), np.zeros(len(q))
        for lo in range(0, len(q), TOGETHER):
            some = order[lo:lo + TOGETHER]
            a, z = np.searchsorted(angle, own[some[0]] - reach, side="left"), np.searchsorted(angle, own[some[-1]] + reach, side="right")
            if a == z:
                continue
            compared[some] = z - a
            sims = np.round(unit[a:z] @ q[some].T, 7)
            allowed = np.ones(sims.shape, bool) if floor is None else sims >= floor
            if exclude_self:
                allowed &= ids[a:z, None] != query_ids[None, some]
            best.add(sims, ids[a:z], allowed, lo)
        if count_pairs:
            yield pa.RecordBatch.from_arrays([pa.array(query_ids, types[0]), pa.array(ids[:1].repeat(len(q)), types[1]), pa.array(compared)], names=["query_id", "id", "similarity"])
        else:
            yield from best.batch(query_ids[order], types)

    return _to_pages(rows, asks).mapInArrow(lambda batches: _pages(batches, read, answer), schema)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, min_similarity: float | None, exclude_self: bool = False, **options) -> DataFrame:
    """Exact top-k of :func:`within`, lengths apart: for query tables that are too large to send to every task."""
    vectors = vectors.where(F.col("vec").isNotNull()).select("id", "vec")
    queries = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    lengths = sorted(r[0] for r in queries.select(F.size("query_vec")).distinct().collect())
    found = [within(queries.where(F.size("query_vec") == d), vectors.where(F.size("vec") == d), k, min_similarity, exclude_self, **options) for d in lengths]
    out = queries.sparkSession.createDataFrame([], vs.id_types(queries, vectors, "id")[0])
    for more in found:
        out = out.unionByName(more)
    return vs.best_of(out, k)


def _lloyd(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of a bounded sample by alternating assignment and means."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(points[i:i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, np.int64)


@dataclass
class Codec:
    """Cell centres, and for each part of the residual its possible values: fitted on at most ``SAMPLE_ROWS`` rows."""

    centres: np.ndarray
    books: np.ndarray

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(unit, self.centres)
        rest = (unit - self.centres[cell]).reshape(len(unit), len(self.books), -1)
        return cell, np.stack([_nearest(np.ascontiguousarray(rest[:, m]), book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)


@dataclass
class Lists:
    """Inverted lists at ``path``: id, codes and vec in one folder per cell."""

    spark: SparkSession
    path: str
    codec: Codec
    n: int
    pages: int

    @cached_property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def build_lists(vectors: DataFrame, path: str, cells: int | None = None, code_bytes: int = CODE_BYTES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Lists:
    """Lists of ``vectors(id, vec)``, all of one length and not zero. ``cells`` defaults to the root of their number, at most ``MOST_CELLS``.

    Only the fit uses a sample, of ``sample_rows`` rows at most; every row is coded and listed.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    sample = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()["vec"].combine_chunks()
    unit, rng = _matrix(sample), np.random.default_rng(seed)
    centres = _lloyd(unit, min(cells or max(1, int(np.sqrt(n))), MOST_CELLS), 10, rng)
    parts = next(m for m in range(min(code_bytes, unit.shape[1]), 0, -1) if unit.shape[1] % m == 0)
    rest = (unit - centres[_nearest(unit, centres)]).reshape(len(unit), parts, -1)
    width = min(CODE_VALUES, len(unit))
    codec = Codec(centres, np.stack([_lloyd(np.ascontiguousarray(rest[:, m]), width, 8, rng) for m in range(parts)]))
    shared = spark.sparkContext.broadcast(codec)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                cell, codes = shared.value.encode(_matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())], names=[*batch.schema.names, "codes", "cell"])

    schema = T.StructType([*vectors.select("id", "vec").schema, T.StructField("codes", T.BinaryType()), T.StructField("cell", T.IntegerType())])
    coded = vectors.select("id", "vec").mapInArrow(code, schema)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [(f"book{m:03}", i, c.tolist()) for m, book in enumerate(codec.books) for i, c in enumerate(book)]
    pages = int(max(1, n // (PAGE_ROWS * len(centres))))
    spark.createDataFrame(values, "kind STRING, row INT, value ARRAY<DOUBLE>").withColumns({"n": F.lit(n), "pages": F.lit(pages)}).coalesce(1).write.parquet(f"{path}/codec")
    coded.repartition(tasks, "cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // 1_000_000)))).sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/lists")
    return Lists(spark, path, codec, n, pages)


def open_lists(spark: SparkSession, path: str) -> Lists:
    """The lists that :func:`build_lists` has written."""
    table = spark.read.parquet(f"{path}/codec").orderBy("kind", "row").toPandas()  # centres and code values, bounded by their counts
    of = lambda kind: np.array(table["value"][table["kind"] == kind].tolist())
    books = sorted(k for k in set(table["kind"]) if k != "centre")
    return Lists(spark, path, Codec(of("centre"), np.stack([of(b) for b in books])), int(table["n"][0]), int(table["pages"][0]))


def probed(lists: Lists, queries: DataFrame, probes: int) -> DataFrame:
    """``(query_id, query_vec, cell)``: the ``probes`` cells whose centres are nearest to each query."""
    shared = lists.spark.sparkContext.broadcast(lists.codec)

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("query_vec"))
            if len(q):
                c = shared.value.centres
                score = q @ c.T - 0.5 * (c * c).sum(axis=1)
                cells = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    asked = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    return asked.mapInArrow(run, T.StructType([*asked.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))])).select("query_id", "query_vec", F.explode("cells").alias("cell"))


def candidates(lists: Lists, queries: DataFrame, probes: int, keep: int) -> DataFrame:
    """``(query_id, query_vec, cell, id)``: of the probed cells the ``keep`` rows per query that their codes put nearest.

    Codes are scored by a table per query and cell: one look-up and sum per byte.
    """
    shared = lists.spark.sparkContext.broadcast(lists.codec)
    asks = probed(lists, queries, probes).select("*", F.explode(F.sequence(F.lit(0), F.lit(lists.pages - 1))).alias("p"))
    asks = asks.select((F.col("cell") * lists.pages + F.col("p")).cast("int").alias("page"), "query_id", "query_vec", "cell")
    rows = lists.rows.select((F.col("cell") * lists.pages + F.pmod(F.xxhash64("id"), F.lit(lists.pages))).cast("int").alias("page"), "id", "codes", "cell")
    rows = rows.join(F.broadcast(asks.select("cell").distinct()), "cell", "left_semi")  # no more cells than MOST_CELLS
    id_types = queries.schema["query_id"].dataType, lists.rows.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", id_types[0]), T.StructField("id", id_types[1]), T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    arrow = [to_arrow_type(t) for t in id_types]

    def read(batch):
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        return batch.column("id").to_numpy(zero_copy_only=False), codes.astype(np.int64), batch.column("cell")[0].as_py()

    def answer(page, batch):
        ids, codes, cell = page
        codec = shared.value
        rest = (_matrix(batch.column("query_vec")) - codec.centres[cell]).reshape(batch.num_rows, len(codec.books), -1)
        queries_here, found, score = [], [], []
        for query_id, r in zip(batch.column("query_id").to_pylist(), rest, strict=True):
            table = ((codec.books - r[:, None, :]) ** 2).sum(axis=2)
            distance = table[np.arange(codes.shape[1]), codes].sum(axis=1)
            best = np.argpartition(distance, keep - 1)[:keep] if len(ids) > keep else np.arange(len(ids))
            queries_here += [query_id] * len(best)
            found.append(ids[best])
            score.append(distance[best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries_here, arrow[0]), pa.array(np.concatenate(found), arrow[1]), pa.array(np.full(len(queries_here), cell), pa.int32()), pa.array(np.concatenate(score))],
            names=["query_id", "id", "cell", "distance"])

    near = _to_pages(rows, asks).mapInArrow(lambda batches: _pages(batches, read, answer), schema)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r", "distance").join(queries.select("query_id", "query_vec"), "query_id")


def approximate(lists: Lists, queries: DataFrame, k: int, min_similarity: float, probes: int, keep: int) -> DataFrame:
    """Top-k among the candidates by exact cosine: ``(query_id, id, similarity, rank)``."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    vec, q = F.col("vec"), F.col("query_vec")
    pairs = candidates(lists, queries, probes, keep).join(lists.rows.select("cell", "id", "vec"), ["cell", "id"])
    scored = pairs.select("query_id", "id", F.round(dot(vec, q) / F.sqrt(dot(vec, vec) * dot(q, q)), 7).alias("similarity")).where(F.col("similarity") >= min_similarity)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
