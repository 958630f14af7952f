"""Label propagation over numbered nodes: neighbours lie in blocks that stay where they are, labels are one array of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage, remove_work, write_work

#: Nodes whose labels are joined as they are, and those whose labels, a number of four bytes each, one process holds.
FEW_NODES, MOST_NODES = 100_000, 1 << 25
#: Neighbour pairs of a block; a node's pairs lie in one block, so that of a hub is as long as they are.
BLOCK_PAIRS = 1 << 14
#: Blocks that go to Python at once.
BATCH_BLOCKS = 64


def numbered(ids: DataFrame) -> DataFrame:
    """``(id, n)``: distinct ids numbered from 0 in their order."""
    lies = cut_lineage(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("lies")), "order")
    part = F.shiftright("lies", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = lies.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return cut_lineage(lies.join(F.broadcast(starts), part == F.col("part")).select("id", (F.col("start") + F.col("lies").bitwiseAND((1 << 33) - 1)).cast("int").alias("n")), "numbers")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (src, dst) sorted by src become blocks of whole sources: sources, their numbers of neighbours, and these, as bytes."""

    def block(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.unique(keys)
        src, dst = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
        cuts = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        ends = np.append(cuts[1:], len(src))
        lo = 0
        while lo < len(cuts):
            hi = max(lo + 1, int(np.searchsorted(ends, cuts[lo] + BLOCK_PAIRS, side="right")))
            a, z = cuts[lo], ends[hi - 1]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (
                src[cuts[lo:hi]], ends[lo:hi] - cuts[lo:hi], dst[a:z])], names=["src", "many", "dst"])
            lo = hi

    rest = np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([rest, (batch.column("src").to_numpy().astype(np.int64) << 32) | batch.column("dst").to_numpy()])
        if len(keys) < 8 * BLOCK_PAIRS:
            rest = keys
            continue
        whole = int(np.searchsorted(keys >> 32, keys[-1] >> 32))  # the last source may go on
        if whole:
            yield from block(keys[:whole])
        rest = keys[whole:]
    if len(rest):
        yield from block(rest)


def numbers_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The numbers of all blocks of a batch, one after the other."""
    return np.frombuffer(b"".join(x.as_buffer() for x in batch.column(column)), "<i4")


def _wanted(labels, moved):
    """For ``mapInArrow`` over blocks: ``(n, next)`` of every node that has a neighbour which moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, new = labels.value, moved.value
        for batch in batches:
            src, many, dst = (numbers_of(batch, c) for c in ("src", "many", "dst"))
            if not len(src):
                continue
            touched = np.logical_or.reduceat(new[dst], np.cumsum(many) - many)
            src, dst, many = src[touched], dst[np.repeat(touched, many)], many[touched]
            if not len(src):
                continue
            keys = np.sort((np.repeat(np.arange(len(src)), many) << 32) | own[dst])
            run = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            votes, of, label = np.diff(np.append(run, len(keys))), keys[run] >> 32, (keys[run] & 0xFFFFFFFF).astype(np.int32)
            score = 2 * votes + (label == own[src[of]])
            best = np.flatnonzero(score == np.maximum.reduceat(score, np.flatnonzero(np.append(True, of[1:] != of[:-1])))[of])
            first = best[np.append(True, of[best][1:] != of[best][:-1])]  # labels ascend
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int32()), pa.array(label[first], pa.int32())], names=["n", "next"])

    return run


def propagate(pairs: DataFrame, ids: DataFrame, rounds: int, stop_when_stable: bool, may_move) -> tuple[DataFrame, bool]:
    """``(id, label)`` after the rounds of :func:`docloom.operators.graph.label_propagation`, and whether they ended by themselves.

    ``pairs(src, dst)``: neighbours, each once or more, in one direction or both; ``ids(id)`` all of their nodes. What a node
    wants depends on its neighbours' labels, so in a round only neighbours of nodes that moved in the one before are asked.
    """
    spark = pairs.sparkSession
    numbers = numbered(ids)
    at = lambda c: numbers.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    half = write_work(pairs.join(at("src"), "src").join(at("dst"), "dst").select("n_src", "n_dst"), "numbered")
    ends = F.explode(F.array(F.struct(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")), F.struct(F.col("n_dst").alias("src"), F.col("n_src").alias("dst"))))
    dealt = spark.read.parquet(half).select(ends.alias("e")).select("e.*").repartition("src").sortWithinPartitions("src")
    listed = write_work(dealt.mapInArrow(_blocks, "src binary, many binary, dst binary"), "blocks")
    remove_work(spark, half)
    blocks = spark.read.parquet(listed)
    n = numbers.count()
    labels, wants, moved = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32), np.ones(n, bool)
    batch, settled = "spark.sql.execution.arrow.maxRecordsPerBatch", False
    size = spark.conf.get(batch)
    for turn in range(1, rounds + 1):
        if moved.any():
            held = spark.sparkContext.broadcast(labels), spark.sparkContext.broadcast(moved)
            spark.conf.set(batch, BATCH_BLOCKS)
            try:
                found = blocks.mapInArrow(_wanted(*held), "n int, next int").toArrow()
            finally:
                spark.conf.set(batch, size)
            wants[found["n"].to_numpy()] = found["next"].to_numpy()
            for x in held:
                x.destroy()
        unsettled = wants != labels
        if stop_when_stable and not unsettled.any():
            settled = True
            break
        able = np.zeros(n, bool)
        able[numbers.where(may_move(F.col("id"), turn)).select("n").toArrow()["n"].to_numpy()] = True
        moved = unsettled & able
        labels[moved] = wants[moved]
    remove_work(spark, listed)
    final = spark.createDataFrame(pa.table({"n": np.arange(n, dtype=np.int32), "at": labels}))
    named = numbers.join(final, "n").select("id", "at").join(numbers.select(F.col("n").alias("at"), F.col("id").alias("label")), "at")
    return cut_lineage(named.select("id", "label"), "labels"), settled
