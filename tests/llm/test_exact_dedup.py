"""Exact duplicates against a plain dictionary."""

import hashlib
import random
from collections import defaultdict

import pytest

from docloom.llm import base, exact_dedup, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id LONG, text STRING, kept STRING, bucket INT, `_hash` STRING, `a.b` INT"


def check(rows, got):
    """``rows`` (id, text) and ``got`` (id, keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        want += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=key) == sorted(want, key=key)
    kept = [(r[4], r[0]) for r in got if r[3]]
    assert len(kept) == len(groups) and {h for h, _ in kept} == {r[4] for r in got}
    assert all(r[0] == r[1] for r in got if r[3])


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in base.table(spark, SF, "documents").select("doc_id", "text").collect()]
    check(rows, [tuple(r) for r in queries.QUERIES["op12_extendible_dedup"](spark, SF).collect()])


@pytest.mark.parametrize("bits, capacity", [(60, 65_536), (60, 4), (5, 3), (0, 1)])
def test_odd_rows(spark, bits, capacity):
    """Nulls, ties, repeated rows, long texts, a third of all rows alike; few bits make hashes collide, small buckets split."""
    rng = random.Random(bits + capacity)
    rows = [(None, "x"), (7, None), (8, ""), (9, "x"), (9, "x"), (10, "é" * 70_000), (11, "é" * 70_000 + "."), (12, "é" * 70_000)]
    rows += [(rng.randrange(400), rng.choice(["hot", f"text {rng.randrange(60)}", f"text {i}"])) for i in range(300)]
    df = spark.createDataFrame([(*r, "k", 1, "h", 2) for r in rows], SCHEMA).repartition(3)
    out = exact_dedup.duplicates(df, bits=bits, capacity=capacity)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check(rows, [tuple(r) for r in out.collect()])
    assert exact_dedup.duplicates(df.limit(0), bits=bits, capacity=capacity).count() == 0


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "t", "k", 1, "h", 2), (2, "t", "k", 1, "h", 3)], SCHEMA)
    out = exact_dedup.duplicates(df, keep=["doc_id", "kept", "bucket", "_hash", "text"])
    assert out.columns == ["doc_id", "bucket", "_hash", "text", *exact_dedup.RESULT]
    assert sorted(tuple(r)[:7] for r in out.collect()) == [(1, 1, "h", "t", 2, 2, False), (2, 1, "h", "t", 2, 2, True)]


def test_directory_doubles(spark):
    """Every key's slot leads to the bucket whose range holds it; no bucket is overfull while bits are left."""
    keys = spark.createDataFrame([(k,) for k in [*range(20), 1000, 2000, 4095]], "_hash LONG")
    slots, depth = exact_dedup.directory(keys, 12, 4)
    rows = slots.collect()
    table = {r.slot: (r.bucket, r.depth) for r in rows}
    assert len(table) == len(rows) and depth == max(d for _, d in table.values()) == 10
    fill = defaultdict(int)
    for k in [*range(20), 1000, 2000, 4095]:
        bucket, d = table[k >> (12 - depth)]
        assert bucket <= k < bucket + (1 << (12 - d))
        fill[bucket] += 1
    assert max(fill.values()) <= 4
