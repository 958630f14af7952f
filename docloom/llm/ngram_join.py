"""Similarity join of documents on word shingles: part signatures, one-level trees over count vectors, exact checks.

Shingles are hashed into groups, and how many fall into each group makes a document a point. Two
sets share at most the sum of the smaller counts of every group, so points whose sum is too small
are no pair. A whole R-tree over all documents would have to be searched everywhere, since shares
of 0.8 and more leave room in every coordinate. So the groups are first dealt into parts: if two
sets differ in at most R shingles and there are more than R parts, one part is the same in both.
Documents with an equal part meet in a cell. Leader checks settle most cells; each of those that are
left has its own tree of one level.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import base
from docloom.llm.components import components

#: Coordinates of a count vector; those of the finer one that pairs of a tree must pass too; points of an R-tree page.
GROUPS, FINE, PAGE = 64, 1024, 16
#: A part that so many documents share is hot; members of the largest component that one cell task holds.
HOT, CELL = 64, 2048
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _group_counts(h: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles fall into each group; ``groups`` is a power of two, and fine groups are parts of coarse ones."""
    return np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: str, k: int, ids: dict) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles. Words: A-Z lower-cased, parted by ASCII white space.

    Fewer words than ``k`` make one shingle; no words make none. ``ids`` remembers hashes of words.
    """
    words = np.array(list(map(ids.__getitem__, text.encode().lower().split())), np.uint64)
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + words[i:n - width + 1 + i])
    return np.unique(total)


@dataclass(frozen=True)
class Rule:
    """Sets link when ``den`` * shared >= ``num`` * union."""

    k: int
    num: int
    den: int

    def links(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)

    def shared_needed(self, total):
        """Least number of shared shingles for two sets with ``total`` shingles together."""
        return -(-self.num * total // (self.num + self.den))

    def windows(self, n: int) -> list[tuple[int, int]]:
        """(lower end, most a smaller set can have) of each size window a set of ``n`` belongs to.

        A pair shares the window of its smaller set: the larger one is at most den / num as large.
        """
        out, low = [], 1
        while low <= n:
            high = max(low + 1, low * 13 // 10)
            if n < high or n * self.num <= (high - 1) * self.den:
                out.append((low, high - 1))
            low = high
        return out

    def parts(self, most: int) -> tuple[int, int, int]:
        """(parts, how many may be weak, size up to which a part is weak) for sets that a smaller one of ``most`` links."""
        differ = (self.den - self.num) * most // self.num
        if differ == 0:
            return 0, 0, 0  # only equal sets link
        spare = 2 + differ // 8
        return differ + 1 + spare, spare, 1 if most >= 7 * differ else 0


def signatures(h: np.ndarray, rule: Rule) -> list[tuple[np.ndarray, int]]:
    """Per size window of a set its part signatures, and how many more of them it may leave out.

    Of the parts of a pair at least 1 + spare are equal. A set with at most ``spare`` weak parts (empty,
    or of one shingle) can therefore leave them out; any other set keeps them all, and -1 says so.
    """
    out = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h + np.uint64(1)), dtype=np.uint64)])
    for low, most in rule.windows(len(h)):
        m, spare, weak_size = rule.parts(most)
        if m == 0:
            continue
        part = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with h, which is sorted
        edge = np.searchsorted(part, np.arange(m + 1, dtype=np.uint64))
        weak = np.diff(edge) <= weak_size
        own = _mix(sums[edge[1:]] - sums[edge[:-1]] + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(low * int(_M2) % 2**64)).view(np.int64)
        left = spare - int(weak.sum())
        out.append((own[~weak], left) if left >= 0 else (own, -1))
    return out


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc"), base.whole(F.col(text)).alias("_text"))


def sketches(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """doc, n (size of the set), cls (digest of the set, null if empty) and counts (the count vector) per row."""

    def run(batch):
        ids = base.Remembered(word_hash)
        out: dict[str, list] = {"doc": batch["doc"], "n": [], "cls": [], "counts": []}
        for t in batch["_text"]:
            h = shingle_set(t, rule.k, ids)
            out["n"].append(len(h))
            out["cls"].append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
            out["counts"].append(_group_counts(h, GROUPS).tolist())
        yield out

    return base.per_batch(_source(df, key, text), run, "doc LONG, n LONG, cls BINARY, counts ARRAY<INT>")


def dealt_signatures(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """sig, doc, allow: one row per signature. A task gives those of equal texts once, for the first it meets."""

    def run(batches):
        ids, seen = base.Remembered(word_hash), base.Remembered(lambda _: False)
        for batch in batches:
            for part in base.slices(batch, ["_text"], 500):
                sig, doc, allow = [], [], []
                for d, t in zip(part.column("doc").to_pylist(), part.column("_text").to_pylist(), strict=True):
                    h = shingle_set(t, rule.k, ids)
                    same = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                    if d is None or seen[same]:
                        continue
                    seen[same] = True
                    for own, left in signatures(h, rule):
                        sig.append(own)
                        doc.append(np.full(len(own), d, np.int64))
                        allow.append(np.full(len(own), left, np.int32))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, doc, allow)], names=["sig", "doc", "allow"])

    return _source(df, key, text).mapInArrow(run, "sig LONG, doc LONG, allow INT")


def _cells(batches):
    """Rows sorted by sig to (sig, doc, allow, hot), for signatures of two and more rows.

    At most HOT rows wait until it is known whether their cell is hot.
    """
    names = ["sig", "doc", "allow", "hot"]

    def rows(sig, doc, allow, hot):
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(doc, pa.int64()), pa.array(allow, pa.int32()), pa.array(hot, pa.bool_())], names=names)

    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    held, hot_sig = nothing, None  # the rows of the last signature so far, or the hot one that passes straight through
    for batch in batches:
        sig, doc, allow = (batch.column(c).to_numpy() for c in ("sig", "doc", "allow"))
        if hot_sig is not None and len(sig):
            same = int(np.searchsorted(sig, hot_sig, "right"))
            if same:
                yield rows(sig[:same], doc[:same], allow[:same], np.ones(same, bool))
            sig, doc, allow = sig[same:], doc[same:], allow[same:]
            hot_sig = None if len(sig) else hot_sig
        if not len(sig):
            continue
        sig, doc, allow = (np.concatenate(x) for x in zip(held, (sig, doc, allow), strict=True))
        begin = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1])
        length = np.diff(np.concatenate([begin, [len(sig)]]))
        last = begin[-1]
        if length[-1] > HOT:
            hot_sig, last, held = sig[-1], len(sig), nothing
        else:
            held = (sig[last:], doc[last:], allow[last:])
        keep = np.repeat(length > 1, length)[:last]
        if keep.any():
            yield rows(sig[:last][keep], doc[:last][keep], allow[:last][keep], np.repeat(length > HOT, length)[:last][keep])
    if len(held[0]) > 1:
        yield rows(*held, np.zeros(len(held[0]), bool))


class CountTree:
    """The lowest level of a packed R-tree over count vectors: pages of points with the largest count of each coordinate.

    There are no levels above it: every asking point scans the upper corners of all pages.
    """

    def __init__(self, fine: np.ndarray, sizes: np.ndarray):
        # The coordinates of the tree are sums of the fine ones, so both bound the overlap from above.
        counts = fine.reshape(len(fine), -1, min(GROUPS, fine.shape[1])).sum(axis=1, dtype=np.int64)
        # Points of like size and like leading coordinates share a page.
        self.order = np.lexsort((counts[:, 1], counts[:, 0], sizes))
        self.fine, self.counts, self.sizes, self.own = fine[self.order], counts[self.order], sizes[self.order], counts
        starts = np.arange(0, len(counts), PAGE)
        self.high = np.maximum.reduceat(self.counts, starts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, starts)

    def partners(self, i: int, fine: np.ndarray, size: int, rule: Rule) -> np.ndarray:
        """Positions (before ordering) of the points whose overlap bounds allow a link with point ``i``."""
        point = self.own[i]
        bound = np.minimum(self.high, point).sum(axis=1)
        pages = np.flatnonzero(bound >= rule.shared_needed(self.least + size))
        if not len(pages):
            return pages
        rows = (pages[:, None] * PAGE + np.arange(PAGE)).ravel()
        rows = rows[rows < len(self.sizes)]
        for vectors, own in ((self.counts, point), (self.fine, fine)):
            rows = rows[np.minimum(vectors[rows], own).sum(axis=1, dtype=np.int64) >= rule.shared_needed(self.sizes[rows] + size)]
        return self.order[rows]


def _cell_pairs(rep: np.ndarray, comp: np.ndarray, sizes: np.ndarray, fine: np.ndarray, rule: Rule):
    """Pairs of a cell of different components that its tree cannot rule out, smaller id first."""
    names, times = np.unique(comp, return_counts=True)
    asking = np.flatnonzero(comp != names[times.argmax()])  # the largest component is met from the other side
    tree = CountTree(fine, sizes)
    for i in asking:
        near = tree.partners(i, fine[i], sizes[i], rule)
        for j in near[comp[near] != comp[i]]:
            yield min(rep[i], rep[j]), max(rep[i], rep[j])


def tree_pairs(rows: DataFrame, rule: Rule, partitions: int) -> DataFrame:
    """Pairs (a, b) of all cells. ``rows(sig, page, rep, comp, n, fine)``; a task reads its cells one after another."""

    def search(batches):
        waiting, key = [], None
        for batch in batches:
            sig, page = batch.column("sig").to_numpy(), batch.column("page").to_numpy()
            cut = np.flatnonzero((sig[1:] != sig[:-1]) | (page[1:] != page[:-1])) + 1
            out: set = set()
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(sig)), strict=True):
                if key != (sig[lo], page[lo]):
                    out.update(one_cell(waiting))
                    waiting, key = [], (sig[lo], page[lo])
                waiting.append(batch.slice(lo, hi - lo))
            yield from as_rows(out)
        yield from as_rows(set(one_cell(waiting)))

    def one_cell(parts):
        if not parts:
            return ()
        cell = pa.Table.from_batches(parts)
        columns = [cell.column(c).to_numpy() for c in ("rep", "comp", "n")]
        return _cell_pairs(*columns, np.frombuffer(b"".join(cell.column("fine").to_pylist()), np.uint16).reshape(len(cell), -1), rule)

    def as_rows(pairs):
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(partitions, "sig", "page").sortWithinPartitions("sig", "page").mapInArrow(search, "a LONG, b LONG")


def _bounded(pairs: DataFrame, points: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) that the summed coordinate minima leave possible."""
    one = points.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("c_a"))
    two = points.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("c_b"))
    bound = F.aggregate(F.zip_with("c_a", "c_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    need = F.lit(rule.num) * (F.col("n_a") + F.col("n_b"))
    return pairs.join(one, "a").join(two, "b").where(bound * (rule.num + rule.den) >= need).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets really link, from whole texts."""
    one, two = texts.select(F.col("rep").alias("a"), F.col("text").alias("t_a")), texts.select(F.col("rep").alias("b"), F.col("text").alias("t_b"))

    def check(batch):
        ids, seen = base.Remembered(word_hash), {}
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, t_a, t_b in zip(batch["a"], batch["b"], batch["t_a"], batch["t_b"], strict=True):
            if seen.get("a") != a:
                seen["a"], seen["set"] = a, shingle_set(t_a, rule.k, ids)
            other = shingle_set(t_b, rule.k, ids)
            if rule.links(len(np.intersect1d(seen["set"], other, assume_unique=True)), len(seen["set"]), len(other)):
                out["a"].append(a)
                out["b"].append(b)
        yield out

    # Joined on a last, so pairs of one leader come together and its set is made once.
    return base.per_batch(pairs.join(two, "b").join(one, "a").select("a", "b", "t_a", "t_b"), check, "a LONG, b LONG")


def linked_components(df: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n (distinct shingles), component (smallest key reachable by links) for every row of ``df``.

    1. Equal sets are one class, stood for by its smallest key, so copies are never paired.
    2. Signatures of classes are sorted into cells; a class that has few hot ones leaves them out.
    3. Twice, every member of a cell is checked against one leader; what links is one component.
    4. Cells that still hold several components are searched by their R-trees, members of the
       largest component in bounded pages, and every pair left possible is checked. So no link
       between two components is missed, and near copies of one text are not all paired.

    A null or blank text has no shingles, links with nothing and is its own component. Rows without
    a key take no part and get a null component. Rows that share a key count as one document.
    """
    spark = df.sparkSession
    made = base.stored(sketches(df, key, text, rule), "sketches")
    some = made.where("cls IS NOT NULL AND doc IS NOT NULL")
    classes = base.stored(some.groupBy("cls").agg(F.min("doc").alias("rep"), F.any_value("n").alias("n"), F.any_value("counts").alias("counts")), "classes")
    points = classes.select("rep", "n", "counts")
    dealt = dealt_signatures(df, key, text, rule).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sig").sortWithinPartitions("sig", "doc")
    found = base.stored(dealt.mapInArrow(_cells, "sig LONG, doc LONG, allow INT, hot BOOLEAN"), "cells")
    rep_of = some.select("doc", "cls").distinct().join(classes.select("cls", "rep"), "cls").select("doc", "rep")
    cells = base.stored(found.join(rep_of, "doc").select("sig", "rep", "allow", "hot").distinct(), "cells")
    # A class may leave out hot parts while, with its weak ones, they are no more than it can spare.
    spare = cells.where("hot").groupBy("rep").agg(F.count("*").alias("hot_parts"), F.min("allow").alias("least"))
    cold = spare.where(F.col("hot_parts") <= F.col("least")).select("rep")
    members = base.stored(cells.where("NOT hot").unionByName(cells.where("hot").join(cold, "rep", "left_anti").select(*cells.columns)).select("sig", "rep"), "members")
    several = members.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    meeting = members.join(several, "sig", "left_semi").select("rep").distinct()
    texts = base.stored(
        df.select(F.col(key).cast("long").alias("rep"), base.whole(F.col(text)).alias("text")).join(meeting, "rep", "left_semi"), "texts")

    def fine_counts(texts):
        ids = base.Remembered(word_hash)
        return {"fine": [_group_counts(shingle_set(t, rule.k, ids), FINE).astype(np.uint16).tobytes() for t in texts]}

    fine = base.stored(base.with_columns(texts, ["text"], fine_counts, "fine BINARY", ["rep"]), "fine")

    links = checked = spark.createDataFrame([], "a LONG, b LONG")
    comps = members.select("rep").distinct().withColumn("comp", F.col("rep"))
    for turn in (0, 1, 2):
        if turn:
            joined = components(links).withColumnRenamed("id", "rep")
            comps = base.stored(members.select("rep").distinct().join(joined, "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp")), "comps")
        now = members.join(comps, "rep")
        mixed = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(turn))).alias("other")).where("lo <> hi")
        if turn < 2:
            pairs = now.join(mixed, "sig").where("comp <> other.comp").select(F.least("rep", "other.rep").alias("a"), F.greatest("rep", "other.rep").alias("b"))
        else:
            left = base.stored(now.join(mixed.select("sig"), "sig", "left_semi").select("sig", "rep", "comp"), "mixed")
            # The pair of a cell of two has been checked in the first turn.
            larger = left.groupBy("sig").agg(F.count("*").alias("c")).where("c > 2").select("sig")
            left = left.join(larger, "sig", "left_semi")
            sized = left.groupBy("sig", "comp").agg(F.count("*").alias("c"))
            main = sized.groupBy("sig").agg(F.max(F.struct("c", "comp")).alias("m")).select("sig", F.col("m.comp").alias("main"), F.ceil(F.col("m.c") / CELL).cast("int").alias("pages"))
            # The rows outside the largest component go to each of its pages.
            pages = F.when(F.col("comp") == F.col("main"), F.array(F.pmod(F.xxhash64("rep"), F.col("pages")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("pages") - 1))
            placed = left.join(main, "sig").withColumn("page", F.explode(pages))
            pairs = tree_pairs(placed.join(points, "rep").join(fine, "rep").select("sig", "page", "rep", "comp", "n", "fine"), rule, int(spark.conf.get("spark.sql.shuffle.partitions")))
        fresh = base.stored(_bounded(pairs.distinct().join(checked, ["a", "b"], "left_anti"), points, rule), "pairs")
        links = links.unionByName(base.stored(_verified(fresh, texts, rule), "links"))
        checked = checked.unionByName(fresh)
    final = components(links).withColumnRenamed("id", "rep")
    named = classes.select("cls", "rep").join(final, "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    return made.select("doc", "n", "cls").join(named, "cls", "left").select(
        "doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def one_of_each(df: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose key is the smallest of its component; rows without a key stay.

    Rows with equal key and equal text become one; rows that share a key but differ in text all stay.
    Of equal rows the one that is smallest by its other columns as JSON stays.
    """
    groups = linked_components(df, rule, key, text)
    kept = groups.where(F.col("doc") == F.col("component")).select(F.col("doc").alias(key)).distinct()
    named = df.join(kept, key, "left_semi")
    others = [c for c in df.columns if c not in (key, text)]
    rest = F.min_by(F.struct(*others), F.to_json(F.struct(*others), {"ignoreNullFields": "false"})) if others else F.lit(None)
    single = named.groupBy(key, text).agg(rest.alias("_rest")).select(*[F.col(f"_rest.{c}").alias(c) if c in others else F.col(c) for c in df.columns])
    return single.unionByName(df.where(F.col(key).isNull()))
