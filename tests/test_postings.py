"""The stored positional index against plain loops over words."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import store, tables
from docloom.operators import postings as ps

WORDS = ["a", "b", "c", "ddd", "é", "x_1", "zz"]


def corpus(rng, n):
    return [(f"c{i}" if i % 7 else f"C{i}", rng.choice([None, "", " ".join(rng.choices(WORDS, [8, 5, 3, 2, 1, 1, 1], k=rng.randrange(1, 40)))])) for i in range(n)]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def fits(q, ws):
    line = f" {' '.join(ws)} "
    return (set(q["must"]) <= set(ws) and (not q["any_of"] or set(q["any_of"]) & set(ws)) and not set(q["none_of"]) & set(ws)
            and all(f" {p} " in line for p in q["phrases"]))


def density(q, ws):
    """Sum over minimal stretches, by trying all of them."""
    groups = [{w} for w in set(q["must"])] + ([set(q["any_of"])] if q["any_of"] else [])
    phrases = [p.split(" ") for p in q["phrases"]]
    if not groups and not phrases:
        return 0.0
    starts = [[i for i in range(len(ws)) if ws[i:i + len(p)] == p] for p in phrases]
    entry = {i for i, w in enumerate(ws) if any(w in g for g in groups)} | {i + j for p, at in zip(phrases, starts) for i in at for j in range(len(p))}
    holds = lambda lo, hi: all(g & set(ws[lo:hi + 1]) for g in groups) and all(any(lo <= i and i + len(p) - 1 <= hi for i in at) for p, at in zip(phrases, starts))
    total = 0.0
    for lo in range(len(ws)):
        for hi in range(lo, len(ws)):
            if holds(lo, hi):
                if not holds(lo + 1, hi):
                    total += ps.COVER / (1 + (hi - lo + 1) - len([i for i in entry if lo <= i <= hi]))
                break
    return round(total, 9)


def queries_of(rng, n):
    pick = lambda most: rng.sample(WORDS + ["none"], rng.randrange(most + 1))
    out = [{"query_id": i, "must": pick(2), "any_of": pick(2), "none_of": pick(1), "phrases": [" ".join(rng.choices(WORDS[:3], k=2))] if rng.random() < 0.3 else [], "terms": pick(4)} for i in range(n)]
    blank = {"must": [], "any_of": [], "none_of": [], "phrases": [], "terms": []}
    return out + [{**blank, "query_id": n, "none_of": ["a", "b"]}, {**blank, "query_id": n + 1}, {**blank, "query_id": n + 2, "phrases": ["a b a"]}, {**blank, "query_id": n + 3, "terms": ["a", "none"]}]


SCHEMA = "query_id INT, must ARRAY<STRING>, any_of ARRAY<STRING>, none_of ARRAY<STRING>, phrases ARRAY<STRING>, terms ARRAY<STRING>"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = corpus(random.Random(3), 120)
    path = str(tmp_path_factory.mktemp("index") / "i")
    chunks = spark.createDataFrame(rows, "chunk_id STRING, content STRING")
    ps.build(chunks, path, shard_chars=400, bucket_chars=200)
    index = ps.open_index(spark, path)
    assert index.n == 120 and index.shards > 3
    qs = queries_of(random.Random(4), 60)
    return dict(rows), chunks, index, qs, spark.createDataFrame([tuple(q[c] for c in ("query_id", "must", "any_of", "none_of", "phrases", "terms")) for q in qs], SCHEMA)


def test_matches(made):
    rows, chunks, index, qs, frame = made
    got = {(r.query_id, r.chunk_id) for r in ps.search(index, frame, "match").collect()}
    want = {(q["query_id"], i) for q in qs for i, t in rows.items() if fits(q, words(t))}
    assert got == want and {i for q, i in want if q == 61} == set(rows)
    allowed = chunks.where(F.col("chunk_id") < "c5")
    got = {(r.query_id, r.chunk_id) for r in ps.search(index, frame, "match", chunks=allowed).collect()}
    assert got == {(q, i) for q, i in want if i < "c5"}


def top(scores, k):
    out = {}
    for q, i, s in sorted(scores, key=lambda r: (r[0], -r[2], r[1])):
        if s > 0 and len(out.setdefault(q, [])) < k:
            out[q].append((i, s))
    return {q: v for q, v in out.items() if v}


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


def test_cover_density(made):
    rows, _, index, qs, frame = made
    want = top([(q["query_id"], i, density(q, words(t))) for q in qs for i, t in rows.items() if fits(q, words(t))], 7)
    assert as_lists(ps.ranked(index, frame, 7, "cover")) == want and len(want) > 10


def test_ranked(made):
    rows, _, index, qs, frame = made
    held = {i: words(t) for i, t in rows.items()}
    mean = sum(map(len, held.values())) / len(held)
    df = {w: sum(w in ws for ws in held.values()) for w in WORDS}

    def okapi(q, ws):
        part = lambda w: math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        return round(sum(part(w) for w in set(q["terms"]) if w in ws), 7)

    want = top([(q["query_id"], i, okapi(q, ws)) for q in qs for i, ws in held.items() if fits(q, ws)], 5)
    got = as_lists(ps.ranked(index, frame, 5))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-7 for q in want for a, b in zip(got[q], want[q]))


@pytest.mark.parametrize("threshold", [0.25, 0.6, 1.0])
def test_similar_sets(spark, tmp_path, threshold):
    """Every pair at or above the threshold and no other; few chunks are compared whole."""
    rng = random.Random(8)
    letters = [f"g{i}" for i in range(300)]
    rows = [(i, list(dict.fromkeys(rng.choices(letters, [1 / (j + 3) for j in range(300)], k=rng.randrange(0, 40))))) for i in range(300)]
    rows += [(1000 + i, ws[:-2] + ["g299"] * ("g299" not in ws)) for i, ws in rows[:60]]
    ps.build(spark.createDataFrame(rows, "chunk_id LONG, ws ARRAY<STRING>").withColumn("content", F.array_join("ws", " ")), str(tmp_path / "i"), F.col("ws"), shard_chars=3000)
    index = ps.open_index(spark, str(tmp_path / "i"))
    qs = [(i, ws[i % 2:] + ["absent"] * (i % 3 == 0)) for i, ws in rows[::5]]
    frame = spark.createDataFrame(qs, "query_id LONG, terms ARRAY<STRING>")
    score = lambda a, b: round(len(set(a) & set(b)) / max(1, len(set(a) | set(b))), 9)
    want = top([(q, i, score(a, b)) for q, a in qs for i, b in rows if score(a, b) >= threshold], 6)
    assert as_lists(ps.ranked(index, frame, 6, "similar", threshold=threshold)) == want
    looked_at = ps.search(index, frame, "looked_at", threshold=threshold).agg(F.sum("score")).first()[0] or 0
    sharing = sum(bool(set(a) & set(b)) and min(len(a), len(b)) >= threshold * max(len(a), len(b)) for _, a in qs for _, b in rows)
    assert len(want) > 5 and looked_at < sharing * (0.8 if threshold < 0.5 else 0.2)


def test_only_asked_buckets_are_read(made):
    _, _, index, _, frame = made
    out = ps.search(index, frame.where("query_id = 62").select("query_id", "phrases"), "match")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert index.buckets > 8 and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("  ", " ") or "PartitionFilters" in plan
    read = {f.split("bucket=")[1].split("/")[0] for f in index.postings.inputFiles()}
    asked = {r[0] for r in frame.sparkSession.createDataFrame([("a",), ("b",)], "t STRING").select(index.bucket(F.col("t"))).collect()} | {index.all_bucket}
    assert all(f" {b}" in plan or f"({b}" in plan or f"[{b}" in plan or f",{b}" in plan for b in asked) and len(asked) < len(read)


def test_empty_corpus(spark, tmp_path, made):
    ps.build(spark.createDataFrame([], "chunk_id LONG, content STRING"), str(tmp_path / "none"))
    index = ps.open_index(spark, str(tmp_path / "none"))
    assert ps.search(index, made[4], "match").count() == 0 and ps.ranked(index, made[4]).count() == 0


def test_built_once(spark, tmp_path):
    """A changed table gets a new index; a build that fails leaves nothing behind."""
    sf = str(tmp_path)
    docs = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
    spark.createDataFrame([(1, "one two", "en", "s", 7)], docs).write.parquet(f"{sf}/documents.parquet")
    first = tables.chunk_index(spark, sf)
    assert tables.chunk_index(spark, sf).path == first.path and first.n == 1
    spark.createDataFrame([(2, "two", "en", "s", 3)], docs).write.mode("append").parquet(f"{sf}/documents.parquet")
    second = tables.chunk_index(spark, sf)
    assert second.path != first.path and second.n == 2 and tables.chunks(spark, sf).count() == 2
    calls = []

    def broken(path):
        calls.append(path)
        spark.range(3).write.parquet(path)
        raise RuntimeError("stopped half-way")

    for _ in range(2):
        with pytest.raises(RuntimeError):
            store.once(spark, "broken", "state", broken)
    assert len(calls) == 2


def test_postings_hold_places_and_are_not_moved_again(made):
    """Chunk ids and lengths lie in one row per shard, positions in one flat array; tasks grow in number, not in size."""
    rows, _, index, _, frame = made
    listed = index.postings.where("shard >= 0").collect()
    assert sorted(i for r in listed for i in r.ids) == sorted(rows)
    for r in listed:
        assert bool(r.ids) == (r.term == ps.ALL) and len(r.ids) == len(r.lens) and len(r.places) == len(r.tfs) and len(r.positions) == sum(r.tfs)
    got = ps.search(index, frame.select("query_id", "any_of"), "match")
    assert "positions" not in got._jdf.queryExecution().sparkPlan().toString()
    assert ps._tasks(10 * ps.TASK_SHARDS, 4) == 10 and ps._tasks(3, 4) == 3


def test_queries_of_all_shards_move_once_per_task(made, spark, monkeypatch):
    """A task keeps them for all its shards; with more queries than a task may hold, blocks of them give the same."""
    rows, _, index, qs, frame = made
    plain = frame.select("query_id", "any_of", "none_of", "terms")
    want = {mode: as_lists(ps.ranked(index, plain, 5, mode)) for mode in ("rank", "cover")}
    matched = sorted(map(tuple, ps.search(index, frame, "match").collect()))
    monkeypatch.setattr(ps, "QUERY_BLOCK", 9)
    assert {mode: as_lists(ps.ranked(index, plain, 5, mode)) for mode in ("rank", "cover")} == want and len(want["rank"]) > 30
    assert sorted(map(tuple, ps.search(index, frame, "match").collect())) == matched
    monkeypatch.undo()

    def counted(*_):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array(["x"]), pa.array([float(sum(batch.column("asks").to_pylist()))])], names=["query_id", "chunk_id", "score"])
        return run

    monkeypatch.setattr(ps, "_answers", counted)
    monkeypatch.setattr(ps, "_tasks", lambda shards, most: 3)
    assert index.shards > 3 and ps.search(index, plain, "rank").agg(F.sum("score")).first()[0] == 3 * len(qs)


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1], [2, 1, 0], [1, 2, 0]])
def test_allowed_chunks_may_come_before_all_chunks(order):
    """Rows of a shard come in any order; the row of allowed chunks has ids, but no lengths."""
    rows = [(ps.ALL, [30, 10, 20], [3, 1, 2], [], []), ("b", [], [], [0, 2], [1, 2]), (ps.ALLOWED, [30, 10], [], [], [])]
    names = ["term", "ids", "lens", "places", "tfs"]
    kinds = [pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
    shard = ps._Shard([pa.RecordBatch.from_arrays([pa.array([rows[i][c]], k) for c, k in enumerate(kinds)], names=names) for i in order])
    assert (shard.ids.tolist(), shard.sizes.tolist(), shard.allowed.tolist()) == ([10, 20, 30], [1, 2, 3], [0, 2])
    assert (shard.docs("b").tolist(), shard.lens.tolist()) == ([2, 1], [3, 2])
