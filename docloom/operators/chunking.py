"""Documents to chunks. Every operator is narrow: one input row explodes into its own chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import ordered
from docloom.functions import text as tx
from docloom.operators.embeddings import RunningEmbedding, hash_embedding

# Words that mark technical prose; more than three of them make it technical.
TECHNICAL_WORDS = ["code", "api", "function", "class", "module", "implementation", "configuration", "parameter"]
HEADER = r"(?m)^#{1,6}\s+.+$"
FENCE = r"```\w*\n?[\s\S]*?```"


def fixed_windows(
    docs: DataFrame,
    size: int = 1000,
    overlap: int = 200,
    min_size: int = 100,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Character windows of ``size`` every ``size - overlap`` characters.

    A window shorter than ``min_size`` is kept only when it reaches the end of the text; the
    index counts kept windows. Windows go on starting until the text is used up, so a short
    pure-overlap tail may follow the window that already reached the end.
    """
    step = size - overlap
    if step <= 0 or overlap < 0:
        raise ValueError("overlap must be at least 0 and smaller than size")
    n = F.length("text")
    starts = F.filter(
        F.sequence(F.lit(0), n - 1, F.lit(step)),
        lambda s: (F.least(s + size, n) - s >= min_size) | (s + size >= n),
    )
    windows = docs.where(n > 0).select(
        "doc_id", *carry, "text", F.posexplode(starts).alias("chunk_index", "start_char")
    )
    content = F.substring(F.col("text"), F.col("start_char") + 1, F.lit(size))
    return windows.select(
        "doc_id",
        *carry,
        "chunk_index",
        "start_char",
        F.least(F.col("start_char") + size, F.length("text")).alias("end_char"),
        content.alias("content"),
        F.sha2(content, 256).alias("content_hash"),
    )


def pack_paragraphs(
    docs: DataFrame, size: int = 1000, overlap: int = 200, min_size: int = 100, separator: str = r"\n\s*\n"
) -> DataFrame:
    """Pack paragraphs up to ``size`` characters, seeding each chunk with the last overlap.

    A fold over the document's own paragraph array: whole texts, no shuffle.
    """
    trimmed = F.transform(F.split("text", separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    paragraphs = F.filter(trimmed, lambda p: p != "")
    empty = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),
        F.lit(0).alias("n"),
        F.lit(0).alias("parts"),
    )

    def add(acc: Column, p: Column) -> Column:
        tail = F.when(F.length(acc["cur"]) > overlap, F.right(acc["cur"], F.lit(overlap))).otherwise(acc["cur"])
        tail = tail if overlap else F.lit("")
        seeded = F.struct(
            F.array_append(acc["done"], acc["cur"]).alias("done"),
            F.when(tail != "", F.concat(tail, F.lit("\n\n"), p)).otherwise(p).alias("cur"),
            (F.length(tail) + F.length(p)).cast("int").alias("n"),
            F.when(tail != "", 2).otherwise(1).alias("parts"),
        )
        grown = F.struct(
            acc["done"].alias("done"),
            F.when(acc["parts"] == 0, p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p)).alias("cur"),
            (acc["n"] + F.length(p)).cast("int").alias("n"),
            (acc["parts"] + 1).cast("int").alias("parts"),
        )
        return F.when((acc["parts"] > 0) & (acc["n"] + F.length(p) > size), seeded).otherwise(grown)

    folded = F.aggregate(
        paragraphs,
        empty,
        add,
        lambda acc: F.when(acc["parts"] > 0, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]),
    )
    kept = F.filter(folded, lambda c: F.length(c) >= min_size)
    return docs.select("doc_id", F.posexplode(kept).alias("chunk_index", "content")).select(
        "doc_id", "chunk_index", "content", F.sha2("content", 256).alias("content_hash"),
        F.length("content").alias("char_count"),
    )


def token_windows(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of whitespace tokens; character offsets are estimated at four per token."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    tokens = docs.select("doc_id", F.length("text").alias("n_chars"), tx.whitespace_tokens(F.col("text")).alias("tok"))
    n = F.size("tok")
    # a window is started only while the one before it stopped short of the end
    last = F.greatest(n - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    win = tokens.where(n > 0).select("doc_id", "n_chars", "tok", F.posexplode(starts).alias("chunk_index", "start"))
    end = F.least(F.col("start") + size, F.size("tok"))
    return win.select(
        "doc_id",
        "chunk_index",
        (end - F.col("start")).alias("token_count"),
        F.least(F.col("start") * 4, F.col("n_chars")).alias("char_start"),
        F.least(end * 4, F.col("n_chars")).alias("char_end"),
        F.array_join(F.slice("tok", F.col("start") + 1, F.lit(size)), " ").alias("content"),
    )


_ENDING = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def prose_and_code(text: str) -> Iterator[tuple[str, bool]]:
    """Sentences and whole fenced blocks in order, with whether they are code. Blank pieces are left out."""
    at = 0
    ranges = [m.span() for m in re.finditer(FENCE, text)]
    for start, end in [*ranges, (len(text), len(text))]:
        yield from ((s.strip(), False) for s in _ENDING.split(text[at:start]) if s.strip())
        if start < end:
            yield text[start:end], True
        at = end


def semantic_sentences(
    docs: DataFrame, threshold: float = 0.85, min_tokens: int = 100, max_tokens: int = 512
) -> DataFrame:
    """Start a new chunk where the next piece is unlike the current chunk.

    Pieces are sentences and fenced blocks; blocks stay whole. Sequential inside a document,
    parallel across documents. A chunk's embedding is kept as a running sum.
    """

    def split_document(content: str) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        pieces: list[str] = []
        tokens, running = 0, RunningEmbedding()
        for piece, _ in prose_and_code(content):
            size = len(piece) // 4
            full = tokens + size > max_tokens
            if pieces and (full or (tokens >= min_tokens and float(np.dot(running.unit(), hash_embedding(piece))) < threshold)):
                out.append((" ".join(pieces), len(pieces)))
                pieces, tokens, running = [], 0, RunningEmbedding()
            pieces.append(piece)
            tokens += size
            running.add(piece)
        return [*out, (" ".join(pieces), len(pieces))] if pieces else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc_id, i, content, sentences)
                for doc_id, text in zip(batch["doc_id"], batch["text"])
                for i, (content, sentences) in enumerate(split_document(text or ""))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content", "sentence_count"])

    out = docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, chunk_index int, content string, sentence_count int"
    )
    return out.withColumn("token_count", tx.approx_tokens(F.col("content")))


def sections(docs: DataFrame, keep_preamble: bool = False) -> DataFrame:
    """Markdown sections with level, parent header and header path.

    The path of a section is folded over the headers before it: for every shallower level the
    nearest one survives. Text before the first header is lost unless
    ``keep_preamble``; a document without headers is one section named ``Document``.
    """
    lines = F.split("text", "\n")
    marks = F.filter(
        F.transform(
            lines,
            lambda line, i: F.struct(
                i.alias("at"),
                F.length(F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 1)).alias("level"),
                F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 2).alias("header"),
            ),
        ),
        lambda m: m["level"] > 0,
    )
    head = lambda at, level, name: F.struct(
        F.lit(at).alias("at"), F.lit(level).alias("level"), F.lit(name).alias("header")
    )
    whole = F.when(F.trim("text") != "", F.array(head(-1, 1, "Document"))).otherwise(F.slice(F.array(head(-1, 1, "")), 1, 0))
    found = F.concat(F.array(head(-1, 0, "")), F.col("marks")) if keep_preamble else F.col("marks")
    flat = (
        docs.select("doc_id", "text", lines.alias("lines"), marks.alias("marks"))
        .withColumn("secs", F.when(F.size("marks") > 0, found).otherwise(whole))
        .select("doc_id", "lines", "secs", F.posexplode("secs").alias("section_no", "sec"))
    )
    first = F.col("sec.at") + 2
    end = F.coalesce(F.try_element_at("secs", F.col("section_no") + 2)["at"], F.size("lines"))
    body = F.slice("lines", first, F.greatest(end - first + 1, F.lit(0)))
    earlier = F.slice("secs", F.lit(1), F.col("section_no"))
    stack = F.aggregate(
        earlier,
        F.slice(F.col("secs"), F.lit(1), F.lit(0)),
        lambda acc, s: F.array_append(F.filter(acc, lambda a: a["level"] < s["level"]), s),
    )
    parents = F.filter(stack, lambda a: a["level"] < F.col("sec.level"))
    content = F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "")
    return flat.select(
        "doc_id",
        "section_no",
        F.col("sec.header").alias("header"),
        F.col("sec.level").alias("level"),
        F.try_element_at(F.transform(parents, lambda a: a["header"]), F.lit(-1)).alias("parent"),
        F.array_append(F.transform(parents, lambda a: a["header"]), F.col("sec.header")).alias("path"),
        content.alias("content"),
    )


def hierarchical(docs: DataFrame, max_tokens: int = 512, max_depth: int = 4, keep_preamble: bool = False) -> DataFrame:
    """Sections cut to ``max_tokens`` at sentence ends; sections nested too deeply are dropped.

    Small sections stay whole (and empty ones stay as empty chunks); long ones are packed
    sentence by sentence.
    """
    secs = sections(docs, keep_preamble).where(F.size("path") <= max_depth)
    parts = tx.sentences(F.col("content"), before_capital=True)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        size = tx.approx_tokens(s)
        full = (acc["cur"] != "") & (acc["n"] + size > max_tokens)
        return F.when(
            full,
            F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), s.alias("cur"), size.alias("n")),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.when(acc["cur"] == "", s).otherwise(F.concat_ws(" ", acc["cur"], s)).alias("cur"),
                (acc["n"] + size).alias("n"),
            )
        )

    packed = F.aggregate(
        parts, empty, add,
        lambda acc: F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]),
    )
    pieces = F.when(tx.approx_tokens(F.col("content")) <= max_tokens, F.array("content")).otherwise(packed)
    out = secs.select("*", F.posexplode(pieces).alias("part", "chunk"))
    return out.select(
        "doc_id", "section_no", "part", "header", "level", "parent",
        F.array_join("path", " > ").alias("path"),
        F.col("chunk").alias("content"),
        tx.approx_tokens(F.col("chunk")).alias("token_count"),
    )


def choose_strategy(docs: DataFrame) -> DataFrame:
    """hierarchical where headers exist, semantic for technical prose, else fixed."""
    low = F.lower("text")
    technical = sum((F.contains(low, F.lit(w)).cast("int") for w in TECHNICAL_WORDS), F.lit(0))
    strategy = F.when(F.col("text").rlike(HEADER), "hierarchical").when(technical > 3, "semantic").otherwise("fixed")
    return docs.withColumn("strategy", strategy)


def chunk_by_strategy(docs: DataFrame) -> DataFrame:
    """Route every document to its chunker and union the chunks."""
    routed = choose_strategy(docs)
    by = lambda name: routed.where(F.col("strategy") == name)
    hier = hierarchical(by("hierarchical")).select(
        "doc_id", "content", "token_count",
        F.struct("section_no", "part").alias("order"),
    )
    sem = semantic_sentences(by("semantic")).select(
        "doc_id", "content", "token_count",
        F.struct(F.col("chunk_index").alias("section_no"), F.lit(0).alias("part")).alias("order"),
    )
    fixed = token_windows(by("fixed")).select(
        "doc_id", "content", "token_count",
        F.struct(F.col("chunk_index").alias("section_no"), F.lit(0).alias("part")).alias("order"),
    )
    tag = lambda df, name: df.withColumn("strategy", F.lit(name))
    return (
        tag(hier, "hierarchical").unionByName(tag(sem, "semantic")).unionByName(tag(fixed, "fixed"))
        .select("doc_id", "strategy", F.col("order.section_no").alias("section_no"),
                F.col("order.part").alias("part"), "token_count", "content")
    )


def chunk_report(chunks: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Chunk count, tokens and size distribution for every level of ``dims``."""
    size = F.length("content")
    return chunks.rollup(*dims).agg(
        F.count("*").alias("n_chunks"),
        F.sum(tx.approx_tokens(F.col("content")).cast("long")).alias("total_tokens"),
        F.min(size).alias("min_chars"),
        F.max(size).alias("max_chars"),
        F.percentile(size, F.lit(0.5)).alias("median_chars"),
    )


def row_blocks(rows: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[str], rows_per_block: int) -> DataFrame:
    """Number the rows of each group in order and pack ``rows_per_block`` of them per block.

    ``slice_col`` cuts a group into ordered pieces, so one huge group is numbered in parallel.
    """
    numbered = ordered.sliced_row_number(rows, group, slice_col, order)
    return numbered.withColumn("block", F.floor((F.col("rn") - 1) / F.lit(rows_per_block)).cast("long")).drop("rn")


def size_blocks(df: DataFrame, items: str, size: int, key: str = "doc_id") -> DataFrame:
    """Pack each row's own item array into blocks of about ``size`` characters.

    A block is closed when the next item would overflow it; an item longer than ``size`` gets a
    block of its own. Cut points come from one fold, block contents are array slices.
    """
    lengths = F.transform(F.col(items), lambda x: F.length(x))
    start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("n"), F.lit(0).alias("i"))
    folded = F.aggregate(
        lengths,
        start,
        lambda acc, n: F.struct(
            F.when((acc["n"] > 0) & (acc["n"] + n > size), F.array_append(acc["cuts"], acc["i"])).otherwise(acc["cuts"]).alias("cuts"),
            F.when((acc["n"] > 0) & (acc["n"] + n > size), n).otherwise(acc["n"] + n).alias("n"),
            (acc["i"] + 1).alias("i"),
        ),
        lambda acc: acc["cuts"],
    )
    out = df.where(F.size(items) > 0).withColumn("_cuts", folded).select("*", F.posexplode("_cuts").alias("block", "_from"))
    until = F.coalesce(F.try_element_at("_cuts", F.col("block") + 2), F.size(items))
    return out.select(key, "block", F.slice(items, F.col("_from") + 1, until - F.col("_from")).alias("content"))
