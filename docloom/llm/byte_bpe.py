"""Byte-level BPE: long texts in overlapping chunks, stitched where their pre-tokens meet again."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docloom.llm import base

#: Characters of a chunk and of the part it shares with the next one.
CHUNK, OVERLAP = 32_768, 512
#: A pre-token is sure of its end if so many characters of the chunk follow: the pattern looks no further ahead.
LOOK_AHEAD = 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _codec(ranks_path: str, pattern: str):
    """The compiled pattern and a memory of what each pre-token gives: (ids as text, count, decoded bytes)."""
    import regex
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    def encode(piece: str) -> tuple[str, int, bytes]:
        ids = encoding.encode_ordinary(piece)  # a pre-token alone is still one pre-token
        return ",".join(map(str, ids)), len(ids), b"".join(map(encoding.decode_single_token_bytes, ids))

    return regex.compile(pattern), base.Remembered(encode)


def chunk_starts(length: int) -> list[int]:
    return list(range(0, max(1, length - OVERLAP), CHUNK))


def bounds(found, start: int) -> list[int]:
    """Where the pre-tokens of a chunk begin, and where the last one ends."""
    at, out = start, [start]
    for piece in found:
        at += len(piece)
        out.append(at)
    return out


def stitch(chunks: list[tuple[int, bool, list[str]]]) -> list[str]:
    """Pre-tokens of a text from those of its chunks (start, is last, pre-tokens), in order.

    Pre-tokens depend only on what follows, so from a place where both chunks begin one, they agree.
    Until the next chunk has such a place the earlier one goes on; if it runs out first, what lies
    between is returned joined, marked by None before it, and is to be split anew.
    """
    out: list = []
    edges = [bounds(found, start) for start, _, found in chunks]
    at, k, i = chunks[0][0], 0, 0
    while True:
        start, last, found = chunks[k]
        end = edges[k][-1]
        if last:
            out.extend(found[i:])
            return out
        follow = {e: n for n, e in enumerate(edges[k + 1])}
        while i < len(found):
            at = edges[k][i]
            if at in follow:
                break
            if edges[k][i + 1] + LOOK_AHEAD > end:
                raise Unmatched
            out.append(found[i])
            i += 1
        else:
            raise Unmatched
        k, i = k + 1, follow[at]


class Unmatched(Exception):
    """Two chunks share no boundary, as inside one very long run of letters."""


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Per row ``keep``, ``ids`` (decimal, comma-joined), ``n_tokens`` and ``decoded`` (bytes).

    A convenience for callers that want the ids; ``digests`` gives what the digests need only.
    """
    return _run(df, ranks_path, pattern, keep, text, False)


def digests(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Per row ``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    return _run(df, ranks_path, pattern, keep, text, True)


def _run(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str, digest: bool) -> DataFrame:
    """Texts become chunks, chunks are pre-tokenised by any task, and the chunks of a text meet again.

    A text of one chunk, which most are, is encoded in place and moves only its results. Only the
    pre-tokens of longer texts are sent to where they are stitched, and a text is the most that meets
    in one task. Equal rows share a key and are told apart by their count, so repeated rows stay
    repeated. Null texts are empty. An empty table gives an empty table.
    """
    spark = df.sparkSession
    values = ("ids_sha256 STRING, decoded_sha256 STRING" if digest else "ids STRING, decoded BINARY")

    def finish(codec, pieces) -> tuple:
        got = list(map(codec.__getitem__, pieces))
        ids, raw = ",".join([g[0] for g in got]), b"".join([g[2] for g in got])
        n = sum([g[1] for g in got])
        return (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) if digest else (n, ids, raw)

    source = df.select(*keep, base.whole(F.col(text)).alias("_text"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("_text") - OVERLAP - 1) / CHUNK).cast("int")))
    rows = source.withColumn("_many", F.length("_text") > CHUNK + OVERLAP)
    short = rows.where(~F.col("_many")).select(*keep, "_text")
    schema = spark.createDataFrame([], f"n_tokens LONG, {values}").schema
    names = [f.name for f in schema]

    def whole_text(batch):
        pat, codec = _codec(ranks_path, pattern)
        done = [finish(codec, pat.findall(t)) for t in batch["_text"]]
        yield {**{c: batch[c] for c in keep}, **{n: [d[i] for d in done] for i, n in enumerate(names)}}

    kept = df.select(*keep).schema
    out_schema = type(kept)([*kept, *schema])
    one = base.per_batch(short, whole_text, out_schema)

    key = F.struct(*[F.col(c) for c in keep], F.xxhash64("_text"), F.length("_text"))
    chunked = (rows.where("_many").withColumn("_key", key).select("_key", "_text", F.explode(starts).alias("_chunk"), F.size(starts).alias("_chunks"))
               .select("_key", "_chunk", "_chunks", F.substring("_text", F.col("_chunk") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("_part")))
    parts_schema = chunked.select("_key", "_chunk", "_chunks").schema.add("_found", ArrayType(StringType()))

    def split(batch):
        pat, _ = _codec(ranks_path, pattern)
        yield {**{c: batch[c] for c in ("_key", "_chunk", "_chunks")}, "_found": [pat.findall(t) for t in batch["_part"]]}

    found = base.per_batch(chunked, split, parts_schema)
    texts = found.groupBy("_key").agg(F.collect_list(F.struct("_chunk", "_chunks", "_found")).alias("_all"))

    def join(batch):
        pat, codec = _codec(ranks_path, pattern)
        out: dict[str, list] = {c: [] for c in [*keep, *names]}
        for k, all_chunks in zip(batch["_key"], batch["_all"], strict=True):
            one_each = {c["_chunk"]: c for c in all_chunks}
            ordered = [one_each[c] for c in sorted(one_each)]
            try:
                pieces = stitch([(c["_chunk"] * CHUNK, c["_chunk"] == c["_chunks"] - 1, c["_found"]) for c in ordered])
            except Unmatched:  # the text is put together again and split from its start
                pieces = pat.findall("".join("".join(c["_found"])[:None if c["_chunk"] == c["_chunks"] - 1 else CHUNK] for c in ordered))
            done = finish(codec, pieces)
            for _ in range(len(all_chunks) // len(ordered)):
                for c in keep:
                    out[c].append(k[c])
                for name, value in zip(names, done, strict=True):
                    out[name].append(value)
        yield out

    return one.unionByName(base.per_batch(texts, join, out_schema))
