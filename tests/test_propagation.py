"""Label propagation over numbered nodes against the rounds that Spark joins."""

import random

import numpy as np
import pytest

from docloom.functions import sizing
from docloom.operators import graph as gr
from docloom.operators import propagation


def some_edges(spark, kind):
    rng = random.Random(9)
    name = (lambda i: f"{i}é") if kind == "STRING" else (lambda i: i * 5 - 60)
    pairs = [(name(i), name(j)) for i in range(70) for j in range(i) if rng.random() < (0.4 if i // 9 == j // 9 else 0.02)]
    hub = [(name(200), name(i)) for i in range(200, 260)]
    return spark.createDataFrame(pairs + pairs[:9] + [(b, a) for a, b in pairs[:9]] + hub + [(name(3), None), (name(4), name(4))], f"src {kind}, dst {kind}")


@pytest.mark.parametrize(("kind", "rounds", "stable"), [("STRING", 100, True), ("LONG", 3, False)])
def test_numbered_nodes_get_the_same_labels(spark, monkeypatch, kind, rounds, stable):
    edges, calls, run = some_edges(spark, kind).repartition(3), [], propagation.propagate
    labelled = lambda: sorted(map(tuple, gr.label_propagation(edges, rounds, stable).collect()))
    want = labelled()
    monkeypatch.setattr(sizing, "is_small", lambda df, rows=sizing.SMALL_ROWS: rows > sizing.SMALL_ROWS)
    monkeypatch.setattr(propagation, "propagate", lambda *a: (calls.append(a), run(*a))[1])
    monkeypatch.setattr(propagation, "BLOCK_PAIRS", 16)
    assert labelled() == want and len(calls) == 1 and len({label for _, label in want}) > 1


def test_blocks_hold_whole_sources_once():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    pairs = sorted((int(a), int(b)) for a, b in zip(rng.integers(0, 40, 900_000) ** 2, rng.integers(0, 30_000, 900_000), strict=True))
    batches = [pa.RecordBatch.from_pylist([{"src": a, "dst": b} for a, b in pairs[i:i + 50_000]], schema=pa.schema([("src", pa.int32()), ("dst", pa.int32())])) for i in range(0, len(pairs), 50_000)]
    got, seen = [], []
    for x in propagation._blocks(iter(batches)):
        src, many, dst = (propagation.numbers_of(x, c) for c in ("src", "many", "dst"))
        seen += src.tolist()
        got += zip(np.repeat(src, many).tolist(), dst.tolist(), strict=True)
    assert got == sorted(set(pairs)) and len(seen) == len(set(seen))


def test_numbers_follow_the_order_of_ids(spark):
    ids = [f"{i}" for i in range(500)]
    got = {r.id: r.n for r in propagation.numbered(spark.createDataFrame([(i,) for i in ids], "id STRING").repartition(5)).collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids))}
