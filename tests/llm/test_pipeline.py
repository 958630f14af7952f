"""The pipeline, stage by stage, against plain loops."""

from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import base, secrets, suffix_dedup, toxicity
from tests.llm.test_ngram_join import brute as brute_join
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def plain_removals(rows):
    first, window = {}, suffix_dedup.WINDOW
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            first[b[p:p + window]] = min(first.get(b[p:p + window], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        out[i] = suffix_dedup.merged([{"start": p, "stop": p + window} for p in range(len(b) - window + 1) if first[b[p:p + window]] < i])
    return out


def test_stages(spark):
    docs = base.table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_join", "suffix_dedup", "secrets", "packing"]
    as_dict = lambda df: {r.doc_id: r.text for r in df.collect()}

    clean = base.stored(stages["toxicity"](spark, docs, SF), "t")
    assert clean.columns == docs.columns
    truth = {r.doc_id: r.toxic for r in base.table(spark, SF, "labels").collect()}
    kept = as_dict(clean)
    gone = set(as_dict(docs)) - set(kept)
    assert not [i for i in gone if truth.get(i) == 0] and gone

    single = base.stored(stages["ngram_join"](spark, clean, SF), "t")
    assert single.columns == docs.columns
    want = {c for _, _, c in brute_join(sorted(kept.items()), corpus_pipeline.NEAR)}
    assert set(as_dict(single)) == want and len(want) < len(kept)

    cut = base.stored(stages["suffix_dedup"](spark, single, SF), "t")
    assert cut.columns == docs.columns
    rows = sorted(as_dict(single).items())
    removed = plain_removals(rows)
    wanted = {i: suffix_dedup.kept_text(t or "", removed[i]) if removed[i] else t for i, t in rows}
    wanted = {i: t for i, t in wanted.items() if t or not removed[i]}
    assert as_dict(cut) == wanted
    assert all(r.n_chars == len(r.text) for r in cut.collect() if removed[r.doc_id])

    safe = base.stored(stages["secrets"](spark, cut, SF), "t")
    assert safe.columns == docs.columns
    texts = as_dict(safe)
    assert set(texts) == set(wanted)
    for i, t in wanted.items():
        spans = secrets.base_spans(t or "")
        if not secrets.candidates(t or ""):
            assert texts[i] == t
        assert not spans or "[secret]" in texts[i]
        assert all(v not in texts[i] for _, k, _, v in spans if k)

    packed = stages["packing"](spark, safe, SF).collect()
    check_packing([tuple(r) for r in packed], list(texts.items()), corpus_pipeline.CAPACITY)


def test_odd_documents_pass_through(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word", "en", None, 4), (3, "word", "en", None, 4)],
                                 "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    for name, stage in corpus_pipeline.STAGES:
        out = base.stored(stage(spark, docs, SF), "t")
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        docs = out
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 3]


def test_clashing_columns_pass_through(spark):
    """Extra columns named like helper columns of the operators, like results, and with a dot."""
    names = ["score", "clauses", "base", "live", "found", "spans", "kept", "touched", "_key", "_rest", "a.b", "component", "doc", "_text", "print"]
    docs = base.table(spark, SF, "documents").where("doc_id < 60").select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.stored(stage(spark, docs, SF), "t")
        rows = docs.collect()
        assert docs.columns[5:] == names and rows, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in rows}


def test_work_tables_go_when_the_next_stage_begins(spark):
    docs = base.table(spark, SF, "documents").where("doc_id < 30")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = base.stored(stage(spark, docs, SF), "t")
    left = dict(corpus_pipeline._LEFT)
    assert list(left) == ["drop_near_copies"] and any(base.exists(spark, p) for p in left["drop_near_copies"])
    base.stored(corpus_pipeline.STAGES[2][1](spark, docs, SF), "t")
    assert not any(base.exists(spark, p) for p in left["drop_near_copies"]) and docs.count() > 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert toxicity.LEXICON > 0
    rows = names["pipeline"](spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
