"""A stored positional index over chunks, and searches that read only the terms they ask for.

Chunks are dealt into shards of bounded size. A row of the postings holds one term in one shard:
the chunks that contain it, as places in the shard's list of chunks, the term's count in each and
its positions, one after the other. One more row per shard lists its chunks and their lengths. Rows lie in
buckets by term, which are folders, so a search opens the folders of its terms only. A search moves
these rows to shards and its queries to the tasks that take them; everything about a chunk is decided in its
shard, and at most ``k`` rows per query leave it. Queries are never collected.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import sizing
from docloom.functions import text as tx
from docloom.operators import text_search as ts
from docloom.operators import vector_search as vs
from docloom.session import shared_dir

#: Characters per shard, and per bucket of terms; cells of a score matrix that a task holds.
SHARD_CHARS, BUCKET_CHARS, MOST_BUCKETS, CELLS = 1_000_000, 16_000_000, 64, 2_000_000
#: Shards that one task takes before there are more tasks.
TASK_SHARDS = 32
#: Queries that one task holds while its shards go by; more of them are dealt into blocks, and shards go to every block.
QUERY_BLOCK = 50_000
#: Queries of which a task makes Python objects at once.
QUERY_SLICE = 1000
#: The entry of all chunks of a shard, and of those that a filter lets through. Words are never so spelt.
ALL, ALLOWED = "", " "
#: Part of the names of stored indexes: what is written differently needs a new one.
LAYOUT = "3"
#: Weight of a cover of query words without other words between (the usual weight of plain text).
COVER = 0.1


#: Arrays of a posting row: all chunks of the shard and their lengths, in its row ``ALL`` only; of a term the places of
#: its chunks in that list, its count in each, and its positions.
LISTS = ["ids", "lens", "places", "tfs", "positions"]


@dataclass
class Index:
    """Where an index lies, and its totals: chunks, mean words per chunk, shards, buckets, and the bucket of the rows of all chunks."""

    spark: SparkSession
    path: str
    n: int
    avg_len: float
    shards: int
    buckets: int
    all_bucket: int

    @cached_property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @cached_property
    def terms(self) -> DataFrame:
        """term, df."""
        return self.spark.read.parquet(f"{self.path}/terms")

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def shard(self, chunk_id: Column) -> Column:
        return F.pmod(F.xxhash64(chunk_id), F.lit(self.shards)).cast("int")


def _inverted(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (shard, chunk_id, ws) sorted by shard become the posting rows of each shard."""
    parts: list[pa.RecordBatch] = []

    def posting_rows() -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        shard, ids, ws = table["shard"][0].as_py(), table["chunk_id"].combine_chunks(), table["ws"].combine_chunks()
        lens = np.diff(ws.offsets.to_numpy())
        words = ws.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(ids)), lens)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # rows and places ascend already
        code, row, at = code[order], row[order], at[order]
        pair = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, np.int64)
        term = np.flatnonzero(np.append(True, code[pair][1:] != code[pair][:-1])) if len(pair) else np.zeros(0, np.int64)
        # The row of all chunks comes first.
        counts = np.diff(np.append(pair, len(code)))
        names = pa.concat_arrays([pa.array([ALL], pa.string()), words.dictionary.cast(pa.string()).take(pa.array(code[pair][term]))])
        chunks_only = pa.array(np.concatenate([[0], np.full(len(names), len(ids))]), pa.int32())
        holders = pa.array(np.concatenate([[0], term, [len(pair)]]), pa.int32())
        spots = pa.array(np.concatenate([[0], pair[term], [len(code)]]), pa.int32())
        listed = pa.ListArray.from_arrays
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(names), shard), pa.int32()), names, listed(chunks_only, ids.cast(id_type)), listed(chunks_only, pa.array(lens, pa.int32())),
            listed(holders, pa.array(row[pair], pa.int32())), listed(holders, pa.array(counts, pa.int32())), listed(spots, pa.array(at, pa.int32()))],
            names=["shard", "term", *LISTS])

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1), len(shards)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if parts and hi > lo and parts[0].column("shard")[0].as_py() != shards[lo]:
                yield posting_rows()
                parts = []
            if hi > lo:
                parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield posting_rows()


def build(chunks: DataFrame, path: str, tokens: Column | None = None, shard_chars: int = SHARD_CHARS, bucket_chars: int = BUCKET_CHARS) -> None:
    """Write the index of ``chunks(chunk_id, content)`` below ``path``. Ids are unique and not null; a null content has no words.

    ``tokens``, an array of strings that are not empty, may take the place of the words.

    One exchange brings chunks to shards. Posting rows stay where they are made: a task writes those
    of its shards, bucket by bucket, so there are as many files as tasks times buckets, and the number
    of buckets is bounded. A common term has one bounded row per shard.
    """
    spark = chunks.sparkSession
    size = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars")).first()
    shards = int(max(1, size["chars"] // shard_chars, size["n"] // 4096))
    buckets = int(min(MOST_BUCKETS, max(8, size["chars"] // bucket_chars)))
    id_type = chunks.schema["chunk_id"].dataType
    arrow = to_arrow_type(id_type)
    words = F.coalesce(tx.words(F.col("content")) if tokens is None else tokens, F.array().cast("array<string>"))
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("term", T.StringType()),
                           *[T.StructField(c, T.ArrayType(id_type if c == "ids" else T.IntegerType())) for c in LISTS]])
    tasks = _tasks(shards, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Texts are moved and sorted; their words, several times as large, are made where they are counted.
    dealt = chunks.withColumn("_shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")).repartitionById(tasks, F.col("_shard") % tasks).sortWithinPartitions("_shard", "chunk_id")
    rows = dealt.select(F.col("_shard").alias("shard"), "chunk_id", words.alias("ws")).mapInArrow(lambda b: _inverted(b, arrow), schema)
    # A row without chunks, of no shard, so that an index of nothing has its columns too.
    blank = spark.createDataFrame([(-1, ALL, *[[] for _ in LISTS])], schema)
    rows = rows.union(blank).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    written.where(F.col("term") != ALL).groupBy("bucket", "term").agg(F.sum(F.size("places")).alias("df")).select("term", "df").repartition(max(1, buckets // 8), "term").write.parquet(f"{path}/terms")
    every = written.where(F.col("term") == ALL).agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.max("bucket")).first()
    totals = spark.createDataFrame([(int(size["n"]), float(every[0] or 0) / max(1, size["n"]), shards, buckets, every[1] or 0)], "n LONG, avg_len DOUBLE, shards INT, buckets INT, all_bucket INT")
    totals.coalesce(1).write.parquet(f"{path}/totals")


def _tasks(shards: int, most: int) -> int:
    """Tasks for so many shards: ``most``, or as many more as keep each at ``TASK_SHARDS``, so that a task does not grow with the corpus."""
    return min(shards, max(most, -(-shards // TASK_SHARDS)))


def of(chunks: DataFrame, tokens: Column | None = None) -> Index:
    """The index of a table that is searched once or twice, in a work folder of its own."""
    spark = chunks.sparkSession
    path = os.path.join(shared_dir(spark), "docloom", f"index-{uuid.uuid4().hex}")
    build(chunks, path, tokens)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    totals = spark.read.parquet(f"{path}/totals").first()
    return Index(spark, path, totals["n"], totals["avg_len"], totals["shards"], totals["buckets"], totals["all_bucket"])


class _Asked:
    """Queries as Arrow columns; of a slice of them Python objects are made when it is answered."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = self.table["query_id"].combine_chunks()
        lists = [self.table[c].combine_chunks() for c in CLAUSES]
        self.bound = sum(np.diff(a.offsets.to_numpy()) for a in lists) > 0
        if "weights" in self.table.column_names:
            weights = self.table["weights"].combine_chunks()
            self.offsets = weights.offsets.to_numpy() - weights.offsets[0].as_py()
            flat = dict(zip((f.name for f in weights.type.value_type), weights.flatten().flatten(), strict=True))
            terms = flat["term"].dictionary_encode()
            self.vocabulary, self.term = terms.dictionary.to_pylist(), terms.indices.to_numpy()
            if "idf" in flat:
                self.idf = flat["idf"].to_numpy()

    def __len__(self) -> int:
        return len(self.ids)

    def rows(self, lo: int, hi: int) -> list[dict]:
        return self.table.slice(lo, hi - lo).to_pylist()

    def clauses(self, i: int) -> dict:
        return self.table.select(CLAUSES).slice(i, 1).to_pylist()[0]


class _Shard:
    """The posting rows of one shard, as places in its sorted list of chunk ids."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        names = table["term"].to_pylist()
        held = {c: pa.concat_arrays(table[c].chunks) for c in LISTS if c in table.column_names}
        flat = {c: a.flatten().to_numpy(zero_copy_only=False) for c, a in held.items()}
        offsets = {c: held[c].offsets.to_numpy() - held[c].offsets[0].as_py() for c in ("ids", "lens", "places")}
        whole, chosen = names.index(ALL), names.index(ALLOWED) if ALLOWED in names else None
        of_row = lambda c, i: flat[c][offsets[c][i]:offsets[c][i + 1]]  # noqa: E731  # the row of allowed chunks has ids, but no lens, wherever it comes
        order = np.argsort(of_row("ids", whole), kind="stable")
        self.ids, self.sizes = of_row("ids", whole)[order], of_row("lens", whole)[order]
        self.place = np.searchsorted(self.ids, of_row("ids", whole))[flat["places"]]
        self.lens = of_row("lens", whole)[flat["places"]]
        self.span = {t: (offsets["places"][i], offsets["places"][i + 1]) for i, t in enumerate(names) if t not in (ALL, ALLOWED)}
        self.tfs = flat["tfs"]
        if "positions" in held:
            # Occurrences lie in the order of their posting entries.
            self.at, self.at_offsets = flat["positions"], np.concatenate([[0], np.cumsum(self.tfs)])
        self.every = np.arange(len(self.ids))
        self.allowed = None if chosen is None else np.sort(np.searchsorted(self.ids, of_row("ids", chosen)))

    def docs(self, term: str) -> np.ndarray:
        lo, hi = self.span.get(term, (0, 0))
        return self.place[lo:hi]

    def places(self, term: str, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, position) of every occurrence of ``term`` in the chunks ``within``."""
        lo, hi = self.span.get(term, (0, 0))
        chosen = np.arange(lo, hi)[np.isin(self.place[lo:hi], within)]
        counts = self.at_offsets[chosen + 1] - self.at_offsets[chosen]
        starts = np.repeat(self.at_offsets[chosen] - np.cumsum(counts) + counts, counts)
        return np.repeat(self.place[chosen], counts), self.at[starts + np.arange(counts.sum())].astype(np.int64)

    def phrase(self, words: list[str], within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, position of its last word) of every occurrence of a phrase."""
        found, wide = None, 1 << 31
        for i, word in enumerate(words):
            chunk, at = self.places(word, within)
            key = chunk * wide + at + (len(words) - 1 - i)
            found = key if found is None else found[np.isin(found, key, assume_unique=True)]
        return found // wide, found % wide

    def matches(self, query: dict) -> np.ndarray:
        """The chunks that satisfy every clause, the rarest word first."""
        words = {*query["must"], *(w for p in query["phrases"] for w in p.split(" "))}
        lists = sorted((self.docs(w) for w in words), key=len)
        found = self.every if self.allowed is None else self.allowed
        for docs in lists:
            if not len(found):
                return found
            found = np.intersect1d(found, docs, assume_unique=True)
        if query["any_of"] and len(found):
            found = np.intersect1d(found, np.concatenate([self.docs(w) for w in query["any_of"]]))
        for word in query["none_of"]:
            found = np.setdiff1d(found, self.docs(word), assume_unique=True)
        for p in query["phrases"]:
            if len(found):
                found = np.unique(self.phrase(p.split(" "), found)[0])
        return found

    def cover_density(self, query: dict, found: np.ndarray) -> np.ndarray:
        """Per chunk of ``found`` the sum over minimal covers of ``COVER / (1 + words in between)``.

        A cover is a stretch of positions that holds every required word, one of the alternatives if there are any, and every
        phrase, and of which no shorter part does. Words of the query inside it are not in between.
        """
        groups = [[w] for w in dict.fromkeys(query["must"])] + ([list(dict.fromkeys(query["any_of"]))] if query["any_of"] else [])
        wide = 1 << 31
        entries, first, last = [], [], []
        for group in groups:
            keys = np.sort(np.concatenate([c * wide + p for c, p in (self.places(w, found) for w in group)]))
            entries.append(keys)
            first.append(keys)
            last.append(keys)
        for p in query["phrases"]:
            words = p.split(" ")
            c, at = self.phrase(words, found)
            key = np.sort(c * wide + at)
            entries += [key - i for i in range(len(words))]
            first.append(key - len(words) + 1)
            last.append(key)
        if not entries:
            return np.zeros(len(found))
        entries = np.unique(np.concatenate(entries))
        # For every place a cover may end at: the latest start from which all groups have appeared.
        ends = np.unique(np.concatenate(last))
        start = ends.copy()
        for f, l in zip(first, last, strict=True):
            i = np.searchsorted(l, ends, side="right") - 1
            start = np.minimum(start, np.where(i >= 0, f[np.maximum(i, 0)], -1))
        good = (start >= 0) & (start // wide == ends // wide)
        start, at = np.unique(start[good], return_index=True)  # of one start the nearest end
        end = ends[good][at]
        inside = np.searchsorted(entries, end) - np.searchsorted(entries, start)
        value = COVER / (1.0 + (end - start) - inside)
        return np.bincount(np.searchsorted(found, start // wide), weights=value, minlength=len(found))[:len(found)]

    def weigh(self, k1: float, b: float, avg_len: float) -> None:
        """The entries of all words by chunk, each with what its count and the chunk's length make of it."""
        names = list(self.span)
        spans = np.array(list(self.span.values()), np.int64).reshape(-1, 2)
        self.code = {t: i for i, t in enumerate(names)}
        code = np.repeat(np.arange(len(names)), spans[:, 1] - spans[:, 0])  # rows follow each other without a gap
        take = np.arange(len(code))
        row = self.place
        order = np.argsort(row, kind="stable")
        take, self.row, self.entry = take[order], row[order], code[order]
        tf = self.tfs[take].astype(float)
        self.x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * self.lens[take] / avg_len))
        self.rows, self.begins = np.unique(self.row, return_index=True)

    def scores(self, asked: _Asked, lo: int, hi: int, code_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, their scores for the queries ``lo`` to ``hi``), rounded to seven digits; ``code_of`` are the terms' codes here, -1 for none."""
        w = np.zeros((len(self.code), hi - lo))
        a, z = asked.offsets[lo], asked.offsets[hi]
        code, column = code_of[asked.term[a:z]], np.repeat(np.arange(hi - lo), np.diff(asked.offsets[lo:hi + 1]))
        w[code[code >= 0], column[code >= 0]] = asked.idf[a:z][code >= 0]
        if not len(self.rows):
            return self.rows, np.zeros((0, hi - lo))
        ends, parts = np.append(self.begins[1:], len(self.row)), []
        for first in range(0, len(self.rows), ts.SLICE_ROWS):
            last = min(first + ts.SLICE_ROWS, len(self.rows))
            a, z = self.begins[first], ends[last - 1]
            parts.append(np.add.reduceat(w[self.entry[a:z]] * self.x[a:z, None], self.begins[first:last] - a, axis=0))
        return self.rows, np.round(np.concatenate(parts), 7)


    def shared_terms(self, query: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(chunks, terms shared with the query) for every chunk whose Jaccard similarity may reach ``threshold``, and how many were looked at.

        A chunk that reaches it shares one of the query's rarest terms at least, all but so many that
        the commonest ones alone cannot do; what it shares of these and the sizes of both sets bound
        the rest. The few that pass are then compared whole.
        """
        n, known = query["size"], sorted(query["weights"], key=lambda t: (t["df"], t["term"]))
        prefix = n - int(np.ceil(threshold * n - 1e-9)) + 1
        rare = known[:max(0, prefix - (n - len(known)))]
        if not rare:
            return self.every[:0], self.every[:0], 0
        counts = np.bincount(np.concatenate([self.docs(t["term"]) for t in rare]), minlength=len(self.ids))
        size = self.sizes
        able = (counts > 0) & (size >= threshold * n - 1e-6) & (threshold * size <= n + 1e-6)
        able &= counts + (len(known) - len(rare)) >= np.ceil(threshold / (1 + threshold) * (n + size) - 1e-6)
        found = np.flatnonzero(able)
        if not len(found):
            return found, found, 0
        asked = np.zeros(len(self.code), dtype=bool)
        asked[[self.code[t["term"]] for t in known if t["term"] in self.code]] = True
        at = np.searchsorted(self.rows, found)
        lo, hi = self.begins[at], np.append(self.begins[1:], len(self.row))[at]
        counts = hi - lo
        first = np.cumsum(counts) - counts
        entries = self.entry[np.repeat(lo - first, counts) + np.arange(counts.sum())]
        return found, np.add.reduceat(asked[entries].astype(np.int64), first), len(found)


CLAUSES = ["must", "any_of", "none_of", "phrases"]
#: In place of a shard's number: a query that is asked of every shard of its task. It sorts before them.
EVERY_SHARD = -1
#: What modes need to know of a query's terms.
WEIGHTS = {"rank": ["term", "idf"], "similar": ["term", "df"], "looked_at": ["term", "df"]}


def _answers(mode: str, k: int, k1: float, b: float, avg_len: float, threshold: float, types: tuple[pa.DataType, pa.DataType]) -> Callable:
    """What a shard task does: queries of all shards come first and are kept, then of every shard its posting rows and queries of its own."""

    def out(query_ids, chunk_ids, scores=None):
        columns = [query_ids if isinstance(query_ids, pa.Array) else pa.array(query_ids, types[0]), pa.array(chunk_ids, types[1])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(query_ids)) if scores is None else scores, pa.float64())], names=["query_id", "chunk_id", "score"])

    def answer(shard: _Shard, queries: list[dict]) -> Iterator[pa.RecordBatch]:
        if mode == "match" or mode == "cover":
            for q in queries:
                found = shard.matches(q)
                if not len(found):
                    continue
                score = np.zeros(len(found))
                if mode == "cover":
                    score = np.round(shard.cover_density(q, found), 9)
                    best = np.lexsort((found, -score))[:k]
                    found, score = found[best], score[best]
                yield out([q["query_id"]] * len(found), shard.ids[found], score)
            return
        for q in queries:
            found, shared, looked_at = shard.shared_terms(q, threshold)
            if mode == "looked_at":
                yield out([q["query_id"]], shard.ids[:1], [float(looked_at)])
                continue
            score = np.round(shared / np.maximum(1, q["size"] + shard.sizes[found] - shared), 9)
            keep = score >= threshold
            if shard.allowed is not None or any(q[c] for c in CLAUSES):
                keep &= np.isin(found, shard.matches(q))
            found, score = found[keep], score[keep]
            best = np.lexsort((found, -score))[:k]
            if len(best):
                yield out([q["query_id"]] * len(best), shard.ids[found[best]], score[best])

    def rank(shard: _Shard, asked: _Asked) -> Iterator[vs.Best]:
        """The shard's best of every query, slice by slice."""
        code_of = np.array([shard.code.get(t, -1) for t in asked.vocabulary], np.int64)
        step = max(1, CELLS // max(1, len(shard.ids), len(shard.code)))
        for lo in range(0, len(asked), step):
            rows, scores = shard.scores(asked, lo, min(lo + step, len(asked)), code_of)
            able = scores > 0
            for j in range(able.shape[1]):
                if shard.allowed is not None or asked.bound[lo + j]:
                    able[:, j] &= np.isin(rows, shard.matches(asked.clauses(lo + j)))
            best = vs.Best(k)
            best.add(scores, shard.ids[rows], able, lo)
            if len(best.query):
                yield best

    def named(best: vs.Best, asked: _Asked) -> pa.RecordBatch:
        return out(asked.ids.take(pa.array(best.query)), best.ids, best.score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_all, everything, tops = [], None, vs.Best(k)
        held, shard, current = [], None, None

        def opened() -> _Shard:
            made = _Shard(held)
            if mode in ("rank", "similar", "looked_at"):
                made.weigh(k1, b, avg_len)
            return made

        def ended() -> Iterator[pa.RecordBatch]:
            """The shard that goes by is whole: what is asked of every shard is answered, ranked queries when the task ends."""
            nonlocal everything
            if not held or not to_all:
                return
            if everything is None:
                everything = _Asked(to_all)
            last = opened() if shard is None else shard
            if mode == "rank":
                parts = list(rank(last, everything))
                if parts:
                    tops.merge(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("query", "ids", "score")))
                return
            for lo in range(0, len(everything), QUERY_SLICE):
                yield from answer(last, everything.rows(lo, min(lo + QUERY_SLICE, len(everything))))

        for batch in batches:
            cuts = np.flatnonzero(np.append(True, (np.diff(batch.column("shard").to_numpy()) != 0) | (np.diff(batch.column("asks").to_numpy(zero_copy_only=False).astype(int)) != 0)))
            asks_of = [c for c in ("query_id", *CLAUSES, "weights", "size") if c in batch.schema.names]
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                number, asks = part.column("shard")[0].as_py(), part.column("asks")[0].as_py()
                if number == EVERY_SHARD:
                    to_all.append(part.select(asks_of).take(pa.array(np.arange(hi - lo))))  # a copy, without the columns of postings
                    continue
                if number != current:
                    yield from ended()
                    held, shard, current = [], None, number
                if not asks:
                    held.append(part)
                    continue
                if not held:
                    continue
                if shard is None:
                    shard = opened()
                some = _Asked([part.select(asks_of)])
                if mode == "rank":
                    yield from (named(best, some) for best in rank(shard, some))
                else:
                    yield from answer(shard, some.rows(0, len(some)))
        yield from ended()
        if len(tops.query):
            yield named(tops, everything)

    return run


def search(index: Index, queries: DataFrame, mode: str, k: int = 10, chunks: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, threshold: float = 0.3, max_k: int | None = None) -> DataFrame:
    """``(query_id, chunk_id, score)`` in one of four modes.

    ``match``: all chunks that satisfy every clause (score 0). ``cover``: the k best of these by
    cover density. ``rank``: the k best by Okapi score over the query's ``terms`` among those.
    ``similar``: the k best by Jaccard similarity of the query's distinct ``terms`` and the chunk's
    tokens, which must be distinct, at or above ``threshold``; ``looked_at`` says instead how many
    chunks of a shard were compared whole for a query.
    ``queries(query_id, must, any_of, none_of, phrases, terms)`` holds arrays of words, phrases as
    words joined by one blank; a missing column is empty. A query of ``none_of`` only, or of nothing
    at all, matches every other chunk. ``chunks``, if given, are those allowed to be found;
    document frequencies stay those of the whole index. In mode ``rank`` a chunk needs one term.
    """
    k = vs.checked_k(k, max_k)
    spark = index.spark
    empty = F.array().cast("array<string>")
    q = queries.select("query_id", *[(F.coalesce(F.col(c), empty) if c in queries.columns else empty).alias(c) for c in [*CLAUSES, "terms"]])
    required = F.array_distinct(F.concat("must", F.flatten(F.transform("phrases", lambda p: F.split(p, " ")))))
    asked = q.select("query_id", F.explode(F.array_distinct(F.concat(required, "any_of", "none_of", "terms"))).alias("term"))
    asked = asked.join(index.terms, "term")
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))

    # Every query with the weights of its terms and, if it requires words, the rarest of them.
    known = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "df", idf.alias("idf"))).alias("known"))
    q = q.withColumn("required", required).join(known, "query_id", "left")
    fields = WEIGHTS.get(mode, [])
    weights = F.transform(F.filter("known", lambda t: F.array_contains(F.col("terms"), t["term"])), lambda t: F.struct(*[t[c].alias(c) for c in fields or ["term"]]))
    asking = ["query_id", *CLAUSES, *(["weights"] if fields else []), "size"]
    must = F.filter("known", lambda t: F.array_contains(F.col("required"), t["term"]))
    q = q.select("query_id", *CLAUSES, F.coalesce(weights, F.array()).alias("weights"), F.size("terms").alias("size"),
                 F.array_min(F.transform(must, lambda t: F.struct(t["df"], t["term"])))["term"].alias("anchor"), F.size("required").alias("needs"),
                 F.coalesce(F.size(must), F.lit(0)).alias("has"))
    q = q.where(F.col("has") >= F.col("needs"))  # a required word that no chunk holds

    vocabulary = asked.select("term").distinct().withColumn("bucket", index.bucket(F.col("term")))
    folders = vocabulary.groupBy("bucket").count().collect()  # at most MOST_BUCKETS numbers of folders
    small = sum(r[1] for r in folders) <= sizing.SMALL_ROWS
    left_out = [] if mode == "cover" or "phrases" in queries.columns else ["positions"]
    rows = index.postings.where("shard >= 0").where(F.col("bucket").isin(sorted({*(r[0] for r in folders), index.all_bucket})))
    wanted = rows.join(sizing.small_side(vocabulary.select("term"), small), "term", "left_semi").unionByName(rows.where((F.col("bucket") == index.all_bucket) & (F.col("term") == ALL)))
    columns = ["shard", "term", *[c for c in LISTS if c not in left_out]]
    stream = wanted.select(*columns)
    if chunks is not None:
        allowed = chunks.select(index.shard(F.col("chunk_id")).alias("shard"), "chunk_id").groupBy("shard").agg(F.collect_list("chunk_id").alias("ids"))
        none = F.array().cast("array<int>")
        stream = stream.unionByName(allowed.select("shard", F.lit(ALLOWED).alias("term"), "ids", *[none.alias(c) for c in columns[3:]]))

    # A query goes to the shards that hold its rarest required word; one without such a word to every task, which keeps it for all its shards.
    tasks = _tasks(index.shards, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) * 4)  # each gets every query
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    here, every = F.col("shard") % tasks, F.sequence(F.lit(0), F.lit(blocks - 1))
    present = rows.select(F.col("term").alias("anchor"), "shard")
    to_some = q.where(F.col("needs") > 0).join(present, "anchor").select("shard", here.alias("task"), *asking)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int") * tasks
    to_all = q.where(F.col("needs") == 0).select(F.lit(EVERY_SHARD).alias("shard"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(tasks - 1)), lambda t: t + block)).alias("task"), *asking)
    stream = stream.withColumn("task", here) if blocks == 1 else stream.withColumn("task", F.explode(F.transform(every, lambda i: i * tasks + here)))
    both = stream.withColumn("asks", F.lit(False)).unionByName(to_some.unionByName(to_all).withColumn("asks", F.lit(True)), allowMissingColumns=True)
    id_types = (queries.schema["query_id"].dataType, index.postings.schema["ids"].dataType.elementType)
    run = _answers(mode, k, k1, b, index.avg_len or 1.0, threshold, tuple(to_arrow_type(t) for t in id_types))
    schema = T.StructType([T.StructField("query_id", id_types[0]), T.StructField("chunk_id", id_types[1]), T.StructField("score", T.DoubleType())])
    found = both.repartitionById(tasks * blocks, F.col("task")).sortWithinPartitions("shard", "asks").mapInArrow(run, schema)
    return found if mode == "match" else found.where(F.col("score") > 0)


def ranked(index: Index, queries: DataFrame, k: int = 10, mode: str = "rank", chunks: DataFrame | None = None, threshold: float = 0.3, max_k: int | None = None) -> DataFrame:
    """The k best of :func:`search` with rank, and the score squeezed to r / (r + 1) as ``rank_score``."""
    return ts.take_top(search(index, queries, mode, k, chunks, threshold=threshold, max_k=max_k), k).withColumn("rank_score", F.col("score") / (F.col("score") + 1))
