"""The n-gram join against all pairs, and the pipeline's choice of one document per group."""

import random
import re

import numpy as np
import pytest

from docloom.llm import base, ngram_join, queries
from docloom.llm.components import components
from docloom.llm.ngram_join import Rule


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, rule):
    """(id, size, component) per row; rows with an id"""
    sets = [(i, shingles(t, rule.k)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(n)
    done = set()
    for at in where.values():
        for x in at:
            for y in at:
                if x < y and (x, y) not in done:
                    done.add((x, y))
                    (a, s), (b, t) = sets[x], sets[y]
                    if rule.den * len(s & t) >= rule.num * len(s | t):
                        ra, rb = root(a), root(b)
                        parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), root(i)) for i, s in sets)


def edited(words, share, rng):
    return [rng.choice("uvwxyz") + w if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))
    rows, passage = [], [word() for _ in range(40)]
    for n in (1, 2, 3, 4, 5, 8, 12, 20, 40, 90, 200, 500):
        for _ in range(4):
            words = [word() for _ in range(n)]
            rows.append(" ".join(words))
            for share in (0.0, 0.004, 0.01, 0.02, 0.04, 0.06):
                rows.append("  ".join(edited(words, share, rng)).title())
            rows.append(" ".join(words + words[: n // 10]))
    chain = [word() for _ in range(150)]
    for _ in range(100):  # a chain of near copies, far apart at its ends
        chain = edited(chain, 0.006, rng)
        rows.append(" ".join(chain))
    for _ in range(120):  # a passage that many documents share
        rows.append(" ".join([*(word() for _ in range(rng.randrange(60, 90))), *passage]))
    for _ in range(120):  # many near copies of one text
        rows.append(" ".join(edited(passage * 3, 0.01, rng)))
    rows += ["", None, "   \t\n", "A", "a", "É e", "é e", rows[10], rows[10], "x y " * 3000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("rule", [Rule(3, 90, 100), Rule(5, 80, 100)])
def test_components_equal_all_pairs(spark, rule, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 8)
    monkeypatch.setattr(ngram_join, "CELL", 16)
    rows = corpus(rule.k)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id LONG, text STRING, rep STRING, n INT")
    got = sorted(tuple(r) for r in ngram_join.linked_components(df, rule).collect())
    assert got == brute(rows, rule)
    kept = ngram_join.one_of_each(df, rule)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (2, None)], "doc_id LONG, text STRING")
    assert sorted(map(str, (tuple(r) for r in ngram_join.linked_components(df, Rule(3, 90, 100)).collect()))) == ["(1, 2, 1)", "(1, 2, 1)", "(2, 0, 2)", "(2, 0, 2)", "(None, 2, None)"]
    assert sorted(str(r.doc_id) for r in ngram_join.one_of_each(df, Rule(3, 90, 100)).collect()) == ["1", "2", "None"]
    assert ngram_join.linked_components(df.limit(0), Rule(3, 90, 100)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in base.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op3_count_tree_join"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows, Rule(3, 90, 100))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({c for _, _, c in want}) < len(want)


def test_windows_cover_every_pair():
    for rule in (Rule(3, 90, 100), Rule(5, 80, 100)):
        for n in range(1, 3000, 7):
            own = set(rule.windows(n))
            assert own and all(set(rule.windows(m)) & own for m in range(n, n * rule.den // rule.num + 1, 5))


def test_some_part_is_always_shared():
    rng = np.random.default_rng(3)
    for rule in (Rule(3, 90, 100), Rule(5, 80, 100)):
        for n in (10, 30, 100, 1000):
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                cut = int(len(a) * (rule.den - rule.num) / rule.den * rng.random())
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 2**63, int(cut * rng.random() / 2), dtype=np.uint64)]))
                if rule.links(len(np.intersect1d(a, b)), len(a), len(b)) and not np.array_equal(a, b):
                    one, two = (np.concatenate([s for s, _ in ngram_join.signatures(x, rule)]) for x in (a, b))
                    assert len(np.intersect1d(one, two))


def test_cells_of_sorted_batches():
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.choice([1, 2, 3, 9, 9, 9, 9, rng.randrange(10, 60)]), i) for i in range(1500))
    batches, at = [], 0
    while at < len(rows):
        n = rng.randrange(0, 200)
        part = rows[at:at + n]
        batches.append(pa.RecordBatch.from_pydict({"sig": pa.array([r[0] for r in part], pa.int64()), "doc": pa.array([r[1] for r in part], pa.int64()), "allow": pa.array([0] * len(part), pa.int32())}))
        at += n
    size = {s: sum(r[0] == s for r in rows) for s, _ in rows}
    got = [r for b in ngram_join._cells(batches) for r in b.to_pylist()]
    assert [(r["sig"], r["doc"]) for r in got] == [r for r in rows if size[r[0]] > 1]
    assert all(r["hot"] == (size[r["sig"]] > ngram_join.HOT) for r in got)


def test_tree_loses_no_partner():
    rng, rule = np.random.default_rng(1), Rule(3, 90, 100)
    first = rng.poisson(3, (40, 2 * ngram_join.GROUPS))
    counts = np.concatenate([np.maximum(first + rng.integers(-1, 2, first.shape) * (rng.random(first.shape) < 0.05), 0) for _ in range(5)]).astype(np.uint16)
    sizes = counts.sum(axis=1, dtype=np.int64)
    tree = ngram_join.CountTree(counts, sizes)
    for i in range(len(counts)):
        want = [j for j in range(len(counts)) if np.minimum(counts[i], counts[j]).sum() >= rule.shared_needed(sizes[i] + sizes[j])]
        assert sorted(tree.partners(i, counts[i], sizes[i], rule)) == want and i in want


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)]
    rng = random.Random(1)
    rng.shuffle(pairs)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_rows_of_one_key_with_different_texts_stay(spark):
    rows = [(1, "one two three four", "b"), (1, "nothing alike in here at all", "a"), (1, "one two three four", "a"), (2, "one two three four", "c"), (3, None, None), (3, None, None), (None, "x", "y")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").repartition(parts)
        got = sorted(map(tuple, ngram_join.one_of_each(df, ngram_join.Rule(3, 80, 100)).collect()), key=str)
        assert got == sorted([(1, "one two three four", "a"), (1, "nothing alike in here at all", "a"), (3, None, None), (None, "x", "y")], key=str)
