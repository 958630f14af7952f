"""Token counts, packing, byte-level BPE and shards against plain loops over small and odd texts."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import base, byte_bpe, packing, queries, sharding, token_counts

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\na\tb\r\n", "x" * 3000, "don't we'll ''ll 's", "<|endoftext|> and <|endoftext|>", "é́   x y  z",
    "日本語 テキスト  です", "A\x1cB \x1c C", "1234 5 67,8.9!?", "tab\t tab", "ǅ İstanbul ΣΑΣ", "same", "same", "word " * 9000, " " * 40000, ("ab" * 20000) + " c", "Mixed​zero", "a\x85b \x85 c",
    "Thin, THE. <|EndOfText|> <|endoftext|>, a<|startoftext|>B. it's, don't! x'S, é, İ. 1, 2.5.", "x" + "'" * 32767 + "ll y" * 3000, "z" * 32766 + "'ll " + "q w" * 12000,
]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)] + [(19, "same", 19), (None, "no id", 0)], "doc_id LONG, text STRING, size LONG")


def multiset(df):
    return Counter(map(tuple, df.collect()))


def all_docs(spark):
    return [tuple(r) for r in base.table(spark, SF, "documents").select("doc_id", "text").collect()]


def brute_counts(rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return Counter((i, len((s or "").encode()), len(t.encode(s or "", add_special_tokens=False).ids)) for i, s in rows)


def test_token_counts(spark, tmp_path):
    cache, tok = str(tmp_path / "cache"), P.path("byte_bpe_50k.json")
    docs = odd_docs(spark)
    want = brute_counts([(r[0], r[1]) for r in docs.collect()])
    assert multiset(token_counts.count_tokens(docs, tok, cache, ["doc_id"])) == want
    before = spark.read.parquet(cache).count()
    assert before == len({t or "" for t in ODD} | {"no id"})
    more = docs.union(spark.createDataFrame([(99, "new text", 1)], docs.schema))
    assert multiset(token_counts.count_tokens(more, tok, cache, ["doc_id"])) == want + brute_counts([(99, "new text")])
    assert spark.read.parquet(cache).count() == before + 1  # only the miss was encoded
    assert token_counts.count_tokens(docs.limit(0), tok, str(tmp_path / "c2"), ["doc_id"]).count() == 0


def test_token_count_query(spark):
    got = queries.QUERIES["op8_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter((r[0], r[1], r[2]) for r in got.collect()) == brute_counts(all_docs(spark))


def bpe_reference():
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_bpe(rows):
    enc, out = bpe_reference(), Counter()
    for i, s in rows:
        ids = enc.encode_ordinary(s or "")
        out[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest())] += 1
        assert enc.decode_bytes(ids) == (s or "").encode()
    return out


def test_byte_bpe_odd_texts(spark):
    docs = odd_docs(spark)
    docs = docs.union(docs.where("doc_id = 21"))  # a repeated long row
    got = byte_bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ["doc_id"])
    assert multiset(got) == brute_bpe([(r[0], r[1]) for r in docs.collect()])


def test_byte_bpe_query(spark):
    assert multiset(queries.QUERIES["op10_byte_bpe"](spark, SF)) == brute_bpe(all_docs(spark))


def test_stitch_equals_one_pass():
    import regex

    pat, rng = regex.compile(P.PATTERN), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", " ", "'ll", "'", "1", ".", "\n", "é"]) for _ in range(rng.randrange(1, 400)))
        step, over = 40, 20
        starts = list(range(0, max(1, len(text) - over), step))
        chunks = [(s, s == starts[-1], pat.findall(text[s:] if s == starts[-1] else text[s:s + step + over])) for s in starts]
        try:
            assert byte_bpe.stitch(chunks) == pat.findall(text)
        except byte_bpe.Unmatched:
            pass


def check_packing(rows, docs, capacity):
    """rows: doc_id, piece, start, length, crc, sequence, offset"""
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, s in docs:
        ids = [*t.encode(s or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[(i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r[5]].append((r[6], r[3]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_packing(spark, capacity):
    docs = odd_docs(spark)
    pieces = base.stored(packing.token_pieces(docs, P.path("word_bpe_49k.json"), capacity, ["doc_id"]), "t")
    rows = packing.pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    check_packing(rows, [(r[0], r[1]) for r in docs.collect()], capacity)
    assert packing.pack(pieces.limit(0), capacity, ["doc_id", "piece"]).count() == 0


def test_packing_query(spark):
    rows = queries.QUERIES["op9_exact_complement_packing"](spark, SF).collect()
    n = check_packing(rows, all_docs(spark), 4096)
    assert n <= 1.03 * -(-sum(r[3] for r in rows) // 4096) + 1


def test_plan_uses_exact_combinations():
    made = packing.plan({10: 2, 7: 1, 3: 3, 5: 1, 2: 1}, 10)
    assert Counter(n for combo, times in made for n in combo * times) == Counter({10: 2, 7: 1, 3: 3, 5: 1, 2: 1})
    assert ((10,), 2) in made and ((7, 3), 1) in made and ((5, 3, 2), 1) in made
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randrange(1, 65): rng.randrange(1, 900) for _ in range(20)}
        made = packing.plan(counts, 64)
        total = Counter()
        for combo, times in made:
            assert sum(combo) <= 64 and times > 0
            for n in combo:
                total[n] += times
        assert dict(total) == counts


def check_shards(rows, shards):
    """rows: doc_id, size, shard, slot"""
    total, largest = sum(r[1] for r in rows), max((r[1] for r in rows), default=0)
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    assert set(by) <= set(range(shards))
    for k, rs in by.items():
        assert sorted(r[3] for r in rs) == list(range(len(rs)))
        assert abs(sum(r[1] for r in rs) - total / shards) <= largest
    order = [r[0] for k in sorted(by) for r in sorted(by[k], key=lambda r: r[3])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_shards(spark):
    docs = odd_docs(spark).drop("size")
    got = sharding.byte_shards(docs, ["doc_id"], sharding.text_size(F.col("text")), 5, partitions=4)
    rows = got.select("doc_id", "size", "shard", "slot").collect()
    assert Counter((r[0], r[1]) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in docs.collect())
    check_shards(rows, 5)
    assert sharding.byte_shards(docs.limit(0), ["doc_id"], sharding.text_size(F.col("text")), 5).count() == 0
    same = spark.range(1000).select(F.lit(1).alias("doc_id"))
    check_shards(sharding.byte_shards(same, ["doc_id"], F.lit(3).cast("long"), 7, partitions=4).select("doc_id", "size", "shard", "slot").collect(), 7)


def test_shard_query(spark):
    got = queries.QUERIES["op6_byte_shards"](spark, SF)
    rows = got.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in all_docs(spark))
    check_shards([(r.doc_id, r.size, r.shard, r.slot) for r in rows], 24)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


@pytest.mark.parametrize("shape", ["uniform", "short", "long", "halves", "two"])
def test_plan_is_never_worse_than_best_fit(shape):
    rng = np.random.default_rng(4)
    lengths = {"uniform": rng.integers(1, 4097, 6000), "short": rng.geometric(1 / 300, 6000).clip(1, 4096), "long": 4096 - rng.geometric(1 / 300, 3000).clip(0, 4095),
               "halves": rng.normal(2048, 200, 4000).astype(int).clip(1, 4096), "two": rng.choice([1500, 2700], 4000)}[shape]
    gaps, used = [], 0
    for n in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(gaps, n)
        if at == len(gaps):
            used += 1
            bisect.insort(gaps, 4096 - n)
        else:
            bisect.insort(gaps, gaps.pop(at) - n)
    made = packing.plan(Counter(lengths.tolist()), 4096)
    assert sum(times for _, times in made) <= used
    assert all(sum(combo) <= 4096 for combo, _ in made)
    back = Counter()
    for combo, times in made:
        for n in combo:
            back[n] += times
    assert back == Counter(lengths.tolist())


def test_encoder_memory_is_bounded(monkeypatch):
    """Batches of ever new words leave no more than the limit and one batch behind; ids stay those of the library."""
    monkeypatch.setattr(packing, "WORDS", 300)
    encode = packing._encoder.__wrapped__(P.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i in range(12):
        texts = [" ".join(f"w{i * j}x{j % 7} Old, words." for j in range(60)) for _ in range(2)]
        got = [np.frombuffer(b, "<u4").tolist() for b in encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        words = next(c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, dict))
        assert 0 < len(words) < 300 + 2 * 130


def test_letters_side_by_side_have_the_ids_of_the_library():
    """Case, composed and decomposed letters, marks at ends, contractions and names of special tokens, in one batch."""
    texts = ["Straße ÉTÉ été İstanbul ıŉǅ ΣΑΣ क़ 가 ſK", "shst### don't rock'n' a'sb we'll,... x_ _x *** <|endoftext|> a<|endoftext|>!! a<| ̸b≯",
             "", " \t\n", "ªº ① 12a a12 queetión,*** A.B. ÀÁ!?", "\x1cA\x85b\xa0C"]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encode = packing._encoder.__wrapped__(P.path("word_bpe_49k.json"))
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_forgets_what_other_operators_remember():
    cleared = []
    base.remembers("one", lambda: cleared.append("one"))
    base.begin("one")
    assert cleared == []
    base.begin("two")
    base.begin("two")
    assert cleared == ["one"]
