"""Batches of text queries against a chunk table."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import vector_search as vs

# Abbreviation expansions.
EXPANSIONS = {
    "ml": ["machine learning"],
    "ai": ["artificial intelligence"],
    "nlp": ["natural language processing"],
    "cv": ["computer vision"],
    "dl": ["deep learning"],
    "nn": ["neural network"],
    "llm": ["large language model"],
    "rag": ["retrieval augmented generation"],
    "api": ["application programming interface"],
    "db": ["database"],
    "ui": ["user interface"],
    "ux": ["user experience"],
}


def take_top(scored: DataFrame, k: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """Rank per query, ids deciding ties; Spark limits each group before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# Cells of a (term, query) weight matrix that every task may hold, and rows that are summed at once.
WEIGHT_CELLS = 4_000_000
SLICE_ROWS = 256


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    padded = F.transform(F.array_distinct(tx.words(text)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def text_or_fuzzy(text_hits: DataFrame, fuzzy_hits: DataFrame, k: int = 10, max_k: int | None = None) -> DataFrame:
    """Either leg matches; the better of the two scores counts.

    Both legs may be cut to their own top-k first: a row that wins by one leg's score is in
    that leg's top-k.
    """
    t = text_hits.select("query_id", "chunk_id", F.round("rank_score", 9).alias("t"))
    f = fuzzy_hits.select("query_id", "chunk_id", F.col("score").alias("f"))
    both = t.join(f, ["query_id", "chunk_id"], "full_outer")
    return take_top(both.select("query_id", "chunk_id", F.greatest("t", "f").alias("score")), vs.checked_k(k, max_k))


def matched_terms(content: Column, terms: Column) -> Column:
    return F.array_sort(F.array_intersect(tx.words(content), terms))


def highlight(content: Column, terms: Column, start: str = "<mark>", end: str = "</mark>") -> Column:
    """Mark every whole-word hit, keeping the original spelling."""
    quoted = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    any_term = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])("), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    return F.when(F.size(terms) == 0, content).otherwise(F.regexp_replace(content, any_term, F.lit(f"{start}$1{end}")))


def fragments(content: Column, terms: Column, most: int = 3, reach: int = 12) -> Column:
    """Up to ``most`` marked stretches of words around hits, from left to right, not overlapping."""
    toks = tx.whitespace_tokens(content)
    hit_at = F.filter(
        F.transform(toks, lambda w, i: F.when(F.arrays_overlap(tx.words(w), terms), i)), lambda i: i.isNotNull()
    )
    centres = F.aggregate(
        hit_at, F.array().cast("array<int>"),
        lambda acc, i: F.when(
            (F.size(acc) < most) & (i > F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-10**6)) + 2 * reach),
            F.array_append(acc, i)).otherwise(acc),
    )
    return F.transform(
        centres,
        lambda i: highlight(F.array_join(F.slice(toks, F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)), " "), terms),
    )


def _coverage(k: int, types: tuple[pa.DataType, pa.DataType]):
    """A shard's texts come first, then queries: one automaton per batch of queries runs once over every text."""

    def answer(ids: np.ndarray, texts: list[str], queries: list[dict]) -> pa.RecordBatch:
        code: dict[str, int] = {}
        for q in queries:
            for t in q["terms"]:
                code.setdefault(t["term"], len(code))
        automaton = ahocorasick.Automaton()
        for term, i in code.items():
            automaton.add_word(term, i)
        automaton.make_automaton()
        held = [np.fromiter({i for _, i in automaton.iter(t)}, dtype=np.int64) for t in texts]
        some = np.array([i for i, h in enumerate(held) if len(h)], dtype=np.int64)
        best = vs.Best(k)
        step = max(1, WEIGHT_CELLS // max(1, len(code), len(ids)))
        for lo in range(0, len(queries) if len(some) else 0, step):
            part = queries[lo:lo + step]
            w = np.zeros((len(code), len(part)))
            for j, q in enumerate(part):
                for t in q["terms"]:
                    w[code[t["term"]], j] = t["n"]
            sums = np.stack([w[held[i]].sum(axis=0) for i in some])
            scores = np.round(sums / np.array([q["total"] for q in part]), 9)
            best.add(scores, ids[some], scores > 0, lo)
        yield from best.batch(np.array([q["query_id"] for q in queries], dtype=object if types[0] == pa.string() else None), types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts = None, [], []
        for batch in batches:
            numbers, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(int)
            cuts = np.flatnonzero(np.append(True, (np.diff(numbers) != 0) | (np.diff(asks) != 0)))
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if numbers[lo] != shard:
                    shard, ids, texts = numbers[lo], [], []
                if asks[lo]:
                    if texts:
                        yield from answer(np.concatenate(ids), texts, part.select(["query_id", "terms", "total"]).to_pylist())
                else:
                    ids.append(part.column("chunk_id").to_numpy(zero_copy_only=False))
                    texts += part.column("content").to_pylist()

    return run


def term_coverage(queries: DataFrame, chunks: DataFrame, k: int = 10, shard_chars: int = 1_000_000) -> DataFrame:
    """Share of a query's words (repeats count) found as substrings of the chunk, best k.

    ``queries(query_id, term, n)`` holds words that are not empty. Chunks lie in shards of bounded size, to each of
    which all queries go; a multi-pattern automaton finds every word of a batch of queries in one
    pass over a text, however long, and no more than k rows per query leave a shard.
    """
    size = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars")).first()
    shards = int(max(1, size["chars"] // shard_chars, size["n"] // 4096))
    asks = queries.groupBy("query_id").agg(F.collect_list(F.struct("term", "n")).alias("terms"), F.sum("n").alias("total"))
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "*")
    rows = chunks.where(F.col("content").isNotNull()).select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "chunk_id", F.lower("content").alias("content"))
    schema, types = vs.id_types(queries, chunks, "chunk_id")
    tasks = min(shards, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    both = rows.unionByName(asks, allowMissingColumns=True).repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "asks")
    found = both.mapInArrow(_coverage(k, types), schema)
    return take_top(found.select("query_id", F.col("id").alias("chunk_id"), F.col("similarity").alias("score")), k)


def expand_abbreviations(queries: DataFrame, table: DataFrame, most: int = 5) -> DataFrame:
    """Append the known expansions of a query's words, in word order.

    ``table(term, n, phrase)`` lists expansions; ``most`` limits them per word.
    """
    toks = queries.select("query_id", "text", F.posexplode(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")).alias("pos", "term"))
    hits = toks.join(table.where(F.col("n") <= most), "term").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "n", "phrase"))).alias("found"))
    return queries.join(hits, "query_id", "left").select(
        "query_id",
        F.concat_ws(" ", "text", F.array_join(F.transform("found", lambda x: x["phrase"]), " ")).alias("expanded"),
        F.coalesce(F.size("found"), F.lit(0)).alias("n_expansions"),
    )


def expand_plurals(queries: DataFrame, most: int = 5) -> DataFrame:
    """Add the other number of every word (with or without a final s), distinct, capped in length."""
    terms = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    varied = F.filter(
        F.transform(
            terms,
            lambda t: F.when(~t.endswith("s") & (F.length(t) > 2), F.concat(t, F.lit("s"))).when(
                t.endswith("s") & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1)),
        ),
        lambda t: t.isNotNull(),
    )
    return queries.select(
        "query_id",
        F.array_join(F.slice(F.array_distinct(F.concat(terms, varied)), F.lit(1), F.size(terms) + most), " ").alias("expanded"),
        F.size(varied).alias("n_variants"),
    )
