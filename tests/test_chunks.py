import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.operators.embeddings import hash_embedding


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols[:2]).collect()]


def test_fixed_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2300))
    got = rows(chunking.fixed_windows(docs(spark, text, "", "short")), "doc_id", "chunk_index", "start_char", "content")
    want = [(0, i, s, text[s:s + 1000]) for i, s in enumerate(range(0, 2300, 800))] + [(2, 0, 0, "short")]
    assert got == want


def test_fixed_windows_reject_endless_overlap(spark):
    with pytest.raises(ValueError):
        chunking.fixed_windows(docs(spark, "x"), size=10, overlap=10)


def pack(text, size, overlap, least):
    out, cur, n = [], [], 0
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if n + len(p) > size and cur:
            done = "\n\n".join(cur)
            out.append(done)
            tail = done[-overlap:] if len(done) > overlap else done
            cur, n = [tail, p], len(tail) + len(p)
        else:
            cur.append(p)
            n += len(p)
    if cur:
        out.append("\n\n".join(cur))
    return [c for c in out if len(c) >= least]


def test_paragraph_packing_matches_a_plain_loop(spark):
    texts = ["\n\n".join(c * n for c, n in zip("abcdefgh", (30, 5, 80, 200, 10, 60, 1, 90))), "one\n \ntwo", "", "x" * 500]
    got = rows(chunking.pack_paragraphs(docs(spark, *texts), 100, 20, 10), "doc_id", "chunk_index", "content")
    want = [(d, i, c) for d, t in enumerate(texts) for i, c in enumerate(pack(t, 100, 20, 10))]
    assert got == want


def test_sections_and_paths(spark):
    text = "lost\n# A\na1\n## B\nb1\nb2\n### C\n## D\nd\n# E\ne"
    got = rows(chunking.sections(docs(spark, text, "no header")), "doc_id", "section_no", "header", "level", "parent", "path", "content")
    assert got == [
        (0, 0, "A", 1, None, ["A"], "a1"), (0, 1, "B", 2, "A", ["A", "B"], "b1\nb2"), (0, 2, "C", 3, "B", ["A", "B", "C"], ""),
        (0, 3, "D", 2, "A", ["A", "D"], "d"), (0, 4, "E", 1, None, ["E"], "e"), (1, 0, "Document", 1, None, ["Document"], "no header")]
    kept = rows(chunking.sections(docs(spark, text), keep_preamble=True), "doc_id", "section_no", "content")
    assert kept[0] == (0, 0, "lost")


def test_hierarchical_splits_long_sections_and_drops_deep_ones(spark):
    sentence = "Word " * 50 + "end."
    text = "# A\n" + " ".join([sentence] * 20) + "\n## B\n### C\n#### D\n##### E\ndeep"
    out = chunking.hierarchical(docs(spark, text), max_tokens=512)
    got = rows(out, "section_no", "part", "token_count")
    assert [g for g in got if g[0] == 0] and max(g[2] for g in got) <= 512 + len(sentence) // 4
    assert {g[0] for g in got} == {0, 1, 2, 3}
    joined = " ".join(r[0] for r in out.where("section_no = 0").orderBy("part").select("content").collect())
    assert joined == " ".join([sentence] * 20)


def test_semantic_chunks_keep_every_sentence_and_code(spark):
    text = "First one here. Second one there. ```py\nx = 1. Y = 2\n``` Third sentence. " + "More words follow now. " * 200
    got = chunking.semantic_sentences(docs(spark, text), min_tokens=5, max_tokens=100).orderBy("chunk_index").collect()
    joined = re.sub(r"\s+", " ", " ".join(r["content"] for r in got))
    assert joined == re.sub(r"\s+", " ", text).strip()
    assert any("```py\nx = 1. Y = 2\n```" in r["content"] for r in got)


def test_hash_embedding_is_a_unit_vector_of_word_hashes():
    v = hash_embedding("alpha beta")
    assert abs((v * v).sum() - 1) < 1e-12 and (v[32:] == 0).all() and hash_embedding("").sum() == 0


def test_strategy_choice_and_routing(spark):
    d = docs(spark, "# T\nbody", "The api class function module works.", "plain text")
    assert [r["strategy"] for r in chunking.choose_strategy(d).orderBy("doc_id").collect()] == ["hierarchical", "semantic", "fixed"]
    assert chunking.chunk_by_strategy(d).select("doc_id").distinct().count() == 3


def test_size_blocks_match_a_plain_loop(spark):
    items = [["a" * n for n in (3, 4, 5, 20, 1, 1, 9)], [], ["x"]]
    df = spark.createDataFrame(list(enumerate(items)), "doc_id long, items array<string>")
    want = []
    for d, xs in enumerate(items):
        blocks, n = [], 0
        for x in xs:
            if blocks and n + len(x) > 10 and n > 0:
                blocks.append([x])
                n = len(x)
            else:
                blocks[-1:] = [[*(blocks[-1] if blocks else []), x]]
                n += len(x)
        want += [(d, i, b) for i, b in enumerate(blocks)]
    assert rows(chunking.size_blocks(df, "items", 10), "doc_id", "block", "content") == want


def test_token_windows(spark):
    text = " ".join(f"t{i}" for i in range(23))
    got = rows(chunking.token_windows(docs(spark, text), 10, 3), "doc_id", "chunk_index", "token_count", "char_start")
    assert got == [(0, 0, 10, 0), (0, 1, 10, 28), (0, 2, 9, 56)]
    assert chunking.token_windows(docs(spark, text), 10, 3).agg(F.max("char_end")).first()[0] == min(23 * 4, len(text))


def test_fenced_blocks_are_whole_pieces_and_placeholders_stay_text():
    text = "One {CODE_BLOCK_0}. Two.\n```py\nx. Y = 1\n```\nThree. four"
    assert list(chunking.prose_and_code(text)) == [("One {CODE_BLOCK_0}.", False), ("Two.", False), ("```py\nx. Y = 1\n```", True), ("Three. four", False)]
