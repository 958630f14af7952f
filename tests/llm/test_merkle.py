"""The manifest against trees built in plain lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import base, merkle, queries

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, at, arity):
    """Root of ``nodes`` and the steps (left, right) of the node at index ``at``."""
    steps = []
    while len(nodes) > 1:
        lo = at // arity * arity
        run = nodes[lo:lo + arity]
        steps.append(("".join(run[:at - lo]), "".join(run[at - lo + 1:])))
        nodes, at = [digest("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)], at // arity
    return nodes[0], steps


def brute(rows, tampered, arity=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots = []
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        roots.append(climb([x[2] for x in groups[s]], 0, arity)[0])
    out = []
    for i, s in enumerate(names):
        root, upper = climb(roots, i, arity)
        leaves = [x[2] for x in groups[s]]
        for j, (_, _, own, row) in enumerate(groups[s]):
            steps = climb(leaves, j, arity)[1] + upper
            fold = leaf(tampered(row))
            for left, right in steps:
                fold = digest(left + fold + right)
            out.append((row[0], own, roots[i], root, digest("".join(a + b for a, b in steps)), fold, fold == root))
    return out


def lowered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 5 or row[4] is None:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


def in_order(rows):
    return sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1:]))


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in base.table(spark, SF, "documents").select(*FIELDS).collect()]
    got = [tuple(r) for r in queries.QUERIES["op13_merkle_manifest"](spark, SF).collect()]
    assert in_order(got) == in_order(brute(rows, lowered))
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("arity, sources", [(16, 1), (2, 5), (3, 40), (16, 40)])
def test_odd_rows(spark, arity, sources):
    """Nulls in every column, equal ids, repeated rows, groups of one and one that holds a third; clashing names beside."""
    rng = random.Random(arity * sources)
    some = lambda v: rng.choice([v, v, v, None])
    names = [None, "", "é", *[f"s{i}" for i in range(sources)]] if sources > 1 else ["only"]
    rows = [(some(rng.randrange(60)), names[0] if i % 3 == 0 else rng.choice(names), some("en"), some(3), some(rng.choice(["Ab", "", "é" * 9000, "abc"]))) for i in range(150)]
    rows += [(1, n, "en", 1, "Z") for n in names] + [rows[0], rows[0], rows[5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING, leaf STRING, `_g` INT").repartition(3)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.when(touched, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.manifest(df, FIELDS, altered={"text": lower}, arity=arity)
    assert got.columns == ["doc_id", *merkle.RESULT]
    assert in_order(tuple(r) for r in got.collect()) == in_order(brute(rows, lowered, arity))
    again = merkle.manifest(df, FIELDS, keep=["doc_id", "leaf", "_g"], arity=arity)
    assert again.columns == ["doc_id", "_g", *merkle.RESULT] and again.where("verified").count() == len(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "T")], "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING")
    assert merkle.manifest(df.limit(0), FIELDS).count() == 0
    one = merkle.manifest(df, FIELDS).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == digest("") and one.verified
