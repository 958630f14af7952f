"""Removal of repeated bytes against a plain dictionary of windows, and the column-wise build against sorting."""

import hashlib
import random

import numpy as np
import pytest

from docloom.llm import base, queries, suffix_dedup
from docloom.llm.suffix_dedup import WINDOW


def brute(rows):
    """(id, bytes, removed, spans, digest) for rows (id, text)"""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - WINDOW + 1):
                w = b[p:p + WINDOW]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for p in range(len(b) - WINDOW + 1):
                if first[b[p:p + WINDOW]] < i:
                    gone[p:p + WINDOW] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def odd_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(30), text(14)
    rows = [text(rng.randrange(1, 120)) for _ in range(60)]
    rows += [text(20) + passage + text(20) for _ in range(20)] + [passage[3:-4], passage, passage + passage, other, "x" + other]
    rows += [rows[3], rows[3], rows[7][5:], rows[9] + rows[10], "ab" * 400, "ab" * 300 + "c", "z" * 5000, "z" * 49, "z" * 50, "y" + "z" * 60, "", None, "é" * 40, "aé" + "é" * 40]
    rows += [rows[0][:40] + rows[1][:60] + rows[2][:80]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_columns_equal_sorting():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 25)
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(0, 70))) for _ in range(n)]
        strings += [strings[0], strings[0]]
        built = suffix_dedup.ColumnBuild(strings)
        suffixes = [strings[o][len(strings[o]) - k:] for o, k in zip(built.owner, built.length)]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(s) + 1 for s in strings)
        for r in range(1, len(suffixes)):
            a, b = suffixes[r - 1], suffixes[r]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert built.common[r] == min(common, WINDOW)


def test_every_window_is_in_one_run():
    rng = random.Random(4)
    for text in [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 49, 50, 51, 400)] + [b"q" * 1000, b"ab" * 500]:
        _, begin, length = suffix_dedup.runs(text)
        covered = [w for b, n in zip(begin, length) for w in range(b, b + n)]
        assert covered == list(range(max(0, len(text) - WINDOW + 1)))
        assert len(length) == 0 or length.max() <= suffix_dedup.RUN


def digests(df):
    def finish(text, removed):
        b = text.encode()
        return len(b), sum(e - s for s, e in removed), len(removed), hashlib.sha256(suffix_dedup.kept_bytes(b, removed)).hexdigest()

    got = suffix_dedup.with_removals(df, finish, "n LONG, r LONG, s LONG, d STRING", ["doc_id"])
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("collection", [suffix_dedup.COLLECTION, 5, 1])
def test_odd_texts(spark, collection, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    monkeypatch.setattr(suffix_dedup, "CROWD", collection)
    rows = odd_rows(collection)
    rows += [rows[5], (None, rows[6][1]), (90_000, rows[8][1]), (90_000, "own words, and " + rows[12][1] if rows[12][1] else "x")]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id LONG, text STRING, start INT, spans STRING")
    assert digests(df) == brute(rows)
    assert digests(df.limit(0)) == []


def test_crowded_anchors_are_handed_on():
    """The stream of one task, with collections so small that anchors must be handed on."""
    import pyarrow as pa

    rng = random.Random(5)
    core = "".join(rng.choice("abcdef") for _ in range(16))
    rows = []
    for doc in range(40):
        s = ("".join(rng.choice("gh") for _ in range(34)) + core + "".join(rng.choice("gh") for _ in range(34))).encode()
        rows += [(7, doc, 0, 0, s), (7, doc + 50, 0, 0, s)]
    rows.sort(key=lambda r: (r[0], r[4], r[1]))
    names = ["anchor", "doc", "print", "start", "string"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    before = suffix_dedup.CROWD
    try:
        for limit in (5, 1000):
            suffix_dedup.CROWD = limit
            batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[lo:lo + 7]], t) for i, t in enumerate(types)], names=names) for lo in range(0, len(rows), 7)]
            out = [r for b in suffix_dedup._removals(batches) for r in b.to_pylist()]
            later = sorted(r["doc"] for r in out if r["string"] is None and r["doc"] >= 50)
            assert later == sorted(r[1] for r in rows if r[1] >= 50)
            handed = sorted(r["string"] for r in out if r["string"] is not None)
            assert handed == (sorted({r[4] for r in rows}) if limit == 5 else [])
    finally:
        suffix_dedup.CROWD = before


def test_kept_text_keeps_whole_characters():
    assert suffix_dedup.kept_text("aéb", [(1, 3)]) == "ab" and suffix_dedup.kept_text("aéb", [(2, 4)]) == "aé" and suffix_dedup.kept_text("aéb", [(0, 2)]) == "éb"


def test_without_repeats(spark):
    line = "a passage of more than fifty bytes that several of the documents share"
    df = spark.createDataFrame([(1, line, "x"), (2, line, "x"), (3, "own words " + line, "x"), (4, None, "x"), (5, "", None)], "doc_id LONG, text STRING, source STRING")
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.without_repeats(df).collect()) == [(1, line), (3, "own words "), (4, None), (5, "")]


def test_query(spark):
    rows = [tuple(r) for r in base.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op5_column_suffix_dedup"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
