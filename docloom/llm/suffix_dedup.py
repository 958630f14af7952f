"""Bytes that repeat an earlier document, found in column-wise built suffix orders of many strings.

A window is a string of ``WINDOW`` bytes. Windows can only be equal if their smallest hashed k-mers
are, so each document is cut into runs of windows that share that anchor. Anchors of one document
alone are dropped; the runs of the others meet by anchor and become collections of short strings.
A collection is built column by column: each round prepends one symbol to every string, finds the
ranks of the new suffixes from the collection's Burrows-Wheeler transform, merges them in one pass,
and updates the common prefixes at the places that changed. Neighbours with a common prefix of
WINDOW bytes are equal windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import base

WINDOW, KMER = 50, 24
#: Windows of a run (longer ones are cut), strings of a collection, and the most strings of one anchor in it.
RUN, COLLECTION, CROWD = 64, 800, 20_000
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _kmer_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all KMER-byte strings, put together from those of 1, 2, 4, ... bytes."""
    h, factor, width, out, have = b.astype(np.uint64) + np.uint64(1), _BASE, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if KMER & width:
                n = len(b) - KMER + 1
                part = h[KMER - have - width:KMER - have - width + n]  # the lowest bits stand last
                out = part if out is None else out + part * above
                above = factor if have == 0 else above * factor
                have += width
            if width * 2 > KMER:
                break
            h, factor, width = h[:-width] * factor + h[width:], factor * factor, width * 2
    out = (out ^ (out >> np.uint64(30))) * _M1
    out = (out ^ (out >> np.uint64(27))) * _M2
    return out ^ (out >> np.uint64(31))


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the runs of a text; each of its windows is in one run."""
    if len(text) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, span, width = _kmer_hashes(np.frombuffer(text, np.uint8)), WINDOW - KMER + 1, 1
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[:width - span], least[span - width:])
    begin = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    length = np.diff(np.concatenate([begin, [len(least)]]))
    if length.max() > RUN:
        parts = -(-length // RUN)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, length = np.repeat(begin, parts) + inside * RUN, np.repeat(length, parts) - inside * RUN
        length = np.minimum(length, RUN)
    return (least[begin] >> np.uint64(16)).view(np.int64), begin, length  # 48 bits are enough to meet by


class ColumnBuild:
    """Suffix order, transform and common prefixes (up to WINDOW) of a collection of short strings.

    ``owner`` and ``length`` name the suffix at each rank, ``before`` the symbol that precedes it
    (0 at a string's beginning), ``common`` how many bytes it shares with the suffix one rank earlier.
    A round reads the columns of the round before it once, from front to back, and writes new ones.
    """

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        width = int(size.max(initial=0))
        # Column j holds the symbol j places before the end; UTF-8 has no byte above 247, so +1 fits.
        symbols = np.zeros((width + 1, len(strings)), np.uint8)
        for i, s in enumerate(strings):
            symbols[:len(s), i] = np.frombuffer(s, np.uint8)[::-1] + 1
        n = len(strings)
        self.owner, self.length = np.arange(n, dtype=np.int32), np.zeros(n, np.uint8)
        self.before, self.common = symbols[0].copy(), np.zeros(n, np.uint8)
        newest = np.arange(n)
        for column in range(1, width + 1):
            newest = newest[self.before[newest] > 0]
            if not len(newest):
                break
            newest = self._insert(newest, symbols[column], column, n)

    def _insert(self, at: np.ndarray, next_symbol: np.ndarray, length: int, strings: int) -> np.ndarray:
        before, total = self.before, len(self.before)
        order = np.argsort(before, kind="stable")  # ranks by the symbol before, so by the suffix it begins
        order = order[np.searchsorted(before[order], 1):]
        where = np.empty(total, np.int64)
        where[order] = np.arange(len(order))
        k = where[at]
        # The neighbours of a new suffix are the extensions of the nearest ranks with the same symbol.
        padded = np.append(self.common, np.uint8(0))
        down = order[np.maximum(k - 1, 0)]
        has_down = (k > 0) & (before[down] == before[at])
        up = order[np.minimum(k + 1, len(order) - 1)]
        has_up = (k + 1 < len(order)) & (before[up] == before[at])
        with_down = self._shared(padded, down, at, has_down)
        with_up = self._shared(padded, at, up, has_up)
        rank = strings + k  # after the empty suffixes
        old = np.ones(total + len(at), bool)
        old[rank] = False
        merged = []
        owner = self.owner[at]
        for column, fresh in ((self.owner, owner), (self.length, np.uint8(length)), (self.before, next_symbol[owner]), (self.common, with_down)):
            out = np.empty(len(old), column.dtype)
            out[old], out[rank] = column, fresh
            merged.append(out)
        self.owner, self.length, self.before, self.common = merged
        self.common[rank[has_up] + 1] = with_up[has_up]
        return rank

    @staticmethod
    def _shared(common: np.ndarray, low: np.ndarray, high: np.ndarray, use: np.ndarray) -> np.ndarray:
        """1 + least common prefix between the ranks after ``low`` up to ``high``, at most WINDOW; 0 where not in use."""
        out = np.zeros(len(low), np.uint8)
        if use.any():
            ends = np.stack([low[use] + 1, high[use] + 1], axis=1).ravel()
            out[use] = np.minimum(np.minimum.reduceat(common, ends)[::2].astype(np.int64) + 1, WINDOW)
        return out


def windows_seen_earlier(strings: list[bytes], first: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per string, as (offset, count) of windows, those that a string of a smaller ``first`` holds too."""
    built = ColumnBuild(strings)
    group = np.cumsum(built.common < WINDOW)
    whole = built.length >= WINDOW
    owner, group, length = built.owner[whole], group[whole], built.length[whole]
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    if not len(owner):
        return out
    docs = first[owner]
    begin = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    least = np.repeat(np.minimum.reduceat(docs, begin), np.diff(np.concatenate([begin, [len(docs)]])))
    hit = least < docs
    size = np.array([len(s) for s in strings])
    who, offset = owner[hit], size[owner[hit]] - length[hit]
    sort = np.lexsort((offset, who))
    for w, o in zip(who[sort].tolist(), offset[sort].tolist(), strict=True):
        mine = out[w]
        if mine and mine[-1][0] + mine[-1][1] == o:
            mine[-1] = (mine[-1][0], mine[-1][1] + 1)
        else:
            mine.append((o, 1))
    return out


def _shared_anchors(batches):
    """Rows sorted by anchor to those whose anchor has two rows and more; one row waits at a time."""
    last, again = None, False  # the last row, and whether the one before it had the same anchor
    for batch in batches:
        anchor, doc = batch.column("anchor").to_numpy(), batch.column("doc").to_numpy()
        if not len(anchor):
            continue
        if last is not None:
            anchor, doc = np.append(last[0], anchor), np.append(last[1], doc)
        same = anchor[1:] == anchor[:-1]
        keep = np.append(again, same)[:-1] | same
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[:-1][keep]), pa.array(anchor[:-1][keep])], names=["doc", "anchor"])
        again = bool(same[-1]) if len(same) else again
        last = (anchor[-1:], doc[-1:])
    if last is not None and again:
        yield pa.RecordBatch.from_arrays([pa.array(last[1]), pa.array(last[0])], names=["doc", "anchor"])


_SPANS = "doc LONG, print INT, start INT, stop INT, windows INT, string BINARY"


def _removals(batches):
    """Runs sorted by anchor, string and document to spans to remove.

    A run whose string an earlier document holds goes whole. The first documents of the strings of
    an anchor are compared through a collection, of which one task holds one at a time. An anchor
    with more than CROWD strings is handed on: its first runs come out with their
    string, to be cut into windows.
    """
    names = ["doc", "print", "start", "stop", "windows", "string"]

    def rows(doc, print_, start, stop, windows=None, string=None):
        n = len(doc)
        return pa.RecordBatch.from_arrays([
            pa.array(doc, pa.int64()), pa.array(print_, pa.int32()), pa.array(start, pa.int32()), pa.array([None] * n if stop is None else stop, pa.int32()),
            pa.array([None] * n if windows is None else windows, pa.int32()), pa.array([None] * n if string is None else string, pa.binary())], names=names)

    done: list = []  # anchors with several strings, each a list of (string, first document, its runs)
    held = 0
    anchor_strings: list = []  # of the anchor that is being read
    current, too_many = None, False

    def build():
        nonlocal done, held
        flat = [x for strings in done for x in strings]
        done, held = [], 0
        if not flat:
            return
        found = windows_seen_earlier([s for s, _, _ in flat], np.array([d for _, d, _ in flat]))
        out = [(doc, pr, start + o, start + o + c + WINDOW - 1) for (_, doc, places), spans in zip(flat, found, strict=True) for o, c in spans for pr, start, _ in places]
        if out:
            yield rows(*zip(*out, strict=True))

    def close():
        """The anchor that was read is complete."""
        nonlocal anchor_strings, held, too_many
        if len(anchor_strings) > 1 and not too_many:
            done.append(anchor_strings)
            held += len(anchor_strings)
        anchor_strings, too_many = [], False

    def hand_on():
        out = [(doc, pr, start, None, windows, s) for s, doc, places in anchor_strings for pr, start, windows in places]
        doc, pr, start, _, windows, s = zip(*out, strict=True)
        anchor_strings.clear()
        return rows(doc, pr, start, None, windows, s)

    last_doc = None  # first document of the last string
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, doc, pr, start = (batch.column(c).to_numpy() for c in ("anchor", "doc", "print", "start"))
        string = batch.column("string")
        windows = pc.binary_length(string).to_numpy() - WINDOW + 1
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | pc.not_equal(string.slice(1), string.slice(0, len(anchor) - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = current is None or (anchor[0], string[0].as_py()) != current
        begin = np.flatnonzero(fresh)
        first = np.where(np.cumsum(fresh) > 0, doc[begin[np.maximum(np.cumsum(fresh) - 1, 0)]] if len(begin) else 0, -1)
        if not fresh[0]:
            head = begin[0] if len(begin) else len(anchor)
            first[:head] = last_doc
        later = doc > first
        if later.any():
            yield rows(doc[later], pr[later], start[later], start[later] + windows[later] + WINDOW - 1)
        for i in np.flatnonzero(~later).tolist():
            if fresh[i]:
                if current is None or anchor[i] != current[0]:
                    if too_many and anchor_strings:
                        yield hand_on()
                    close()
                    if held >= COLLECTION:
                        yield from build()
                anchor_strings.append((string[i].as_py(), int(doc[i]), []))
                current = (anchor[i], None)
            elif not anchor_strings:  # its string was handed on
                anchor_strings.append((string[i].as_py(), int(doc[i]), []))
            anchor_strings[-1][2].append((int(pr[i]), int(start[i]), int(windows[i])))
            if len(anchor_strings) > CROWD or (too_many and len(anchor_strings) > 256):
                too_many = True
                yield hand_on()
        if too_many and anchor_strings:
            yield hand_on()
        current, last_doc = (anchor[-1], string[-1].as_py()), int(first[-1])
    if too_many and anchor_strings:
        yield hand_on()
    close()
    yield from build()


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc"), base.whole(F.col(text)).alias("_text")).withColumn("print", F.hash("_text"))


def later_copies(source: DataFrame) -> DataFrame:
    """doc, print, stop of the rows whose whole text an earlier document has; only hashes are sent."""
    keys = source.select("doc", "print", F.xxhash64("_text").alias("second"), F.octet_length("_text").alias("stop"))
    first = keys.groupBy("print", "second", "stop").agg(F.min("doc").alias("first"))
    return keys.join(first, ["print", "second", "stop"]).select("doc", "print", "stop", (F.col("doc") > F.col("first")).alias("copy"))


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, print (hash of the text) and spans (array of start, stop in UTF-8 bytes, unmerged) to remove.

    A byte is covered if a window over it also starts in a document with a smaller key. A later copy of
    a whole text is covered whole, so only the first of equal texts is compared. Rows without
    a key and texts shorter than a window take no part; rows that share a key never remove from
    one another.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def anchors(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, found, docs = batch.slice(lo, 500), [], []
                for doc, t in zip(part.column("doc").to_pylist(), part.column("_text").to_pylist(), strict=True):
                    own = np.unique(runs(t.encode())[0])
                    found.append(own)
                    docs.append(np.full(len(own), doc, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(docs))], names=["anchor", "doc"])

    source = _source(df, key, text).where(F.col("doc").isNotNull() & (F.octet_length("_text") >= WINDOW))
    pairs = source.select("doc", "_text").mapInArrow(anchors, "anchor LONG, doc LONG").repartition(partitions, "anchor").sortWithinPartitions("anchor")
    shared = base.stored(pairs.mapInArrow(_shared_anchors, "doc LONG, anchor LONG").groupBy("doc").agg(F.collect_list("anchor").alias("anchors")), "anchors")

    rows = base.stored(later_copies(source), "copies")
    # A key goes only if all of its rows are copies.
    gone = rows.groupBy("doc").agg(F.bool_and("copy").alias("all_copies")).where("all_copies").select("doc")
    compared_docs = shared.join(gone, "doc", "left_anti")

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out: list[list] = [[], [], [], [], []]
                part = batch.slice(lo, 500)
                anchors_of = part.column("anchors")
                for i, (doc, pr, t) in enumerate(zip(part.column("doc").to_pylist(), part.column("print").to_pylist(), part.column("_text").to_pylist(), strict=True)):
                    b = t.encode()
                    anchor, begin, length = runs(b)
                    keep = np.isin(anchor, anchors_of[i].values.to_numpy())
                    for a, s, n in zip(anchor[keep].tolist(), begin[keep].tolist(), length[keep].tolist(), strict=True):
                        for column, value in zip(out, (a, doc, pr, s, b[s:s + n + WINDOW - 1]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                                 names=["anchor", "doc", "print", "start", "string"])

    run_schema = "anchor LONG, doc LONG, print INT, start INT, string BINARY"
    cuts = source.join(compared_docs, "doc").select("doc", "print", "_text", "anchors").mapInArrow(cut, run_schema)

    def compared(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(partitions, "anchor").sortWithinPartitions("anchor", "string", "doc")
        return base.stored(dealt.mapInArrow(_removals, _SPANS), "removals")

    found = compared(cuts)
    spans = found.where("string IS NULL").select("doc", "print", "start", "stop").unionByName(
        rows.where("copy").select("doc", "print", F.lit(0).alias("start"), "stop"))
    crowded = found.where("string IS NOT NULL").select("doc", "print", "start", "windows", "string")
    if crowded.limit(1).count():
        # Windows of crowded anchors meet by their own bytes, so equal ones have one string per anchor.
        offset = F.explode(F.sequence(F.lit(0), F.col("windows") - 1))
        single = crowded.select("doc", "print", "start", "string", offset.alias("o")).select(
            "doc", "print", (F.col("start") + F.col("o")).alias("start"), F.substring("string", F.col("o") + 1, F.lit(WINDOW)).alias("string"))
        windows = single.select(F.xxhash64("string").alias("anchor"), "doc", "print", "start", "string")
        spans = spans.unionByName(compared(windows).where("string IS NULL").select("doc", "print", "start", "stop"))
    return spans.groupBy("doc", "print").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in removed:
        out.append(text[at:s])
        at = e
    return b"".join(out) + text[at:]


def kept_text(text: str, removed: list[tuple[int, int]]) -> str:
    """What is left as text: a character goes only if all of its bytes do."""
    b = text.encode()
    lead = lambda i: i >= len(b) or b[i] & 0xC0 != 0x80  # noqa: E731  does a character begin at i?
    fit = []
    for s, e in removed:
        while s < e and not lead(s):
            s += 1
        while e > s and not lead(e):
            e -= 1
        if s < e:
            fit.append((s, e))
    return kept_bytes(b, fit).decode()


def with_removals(df: DataFrame, finish, columns: str, keep: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` and what ``finish(text, removed)`` gives as a tuple for ``columns``, per row of ``df``."""
    found = repeated_spans(df, key, text).withColumnRenamed("doc", "_doc").withColumnRenamed("print", "_print")
    source = df.select(*keep, F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).withColumn("_hash", F.hash(base.whole(F.col("_text"))))
    joined = source.join(found, (F.col("_key") == F.col("_doc")) & (F.col("_hash") == F.col("_print")), "left").select(*keep, "_text", "spans")
    names = df.sparkSession.createDataFrame([], columns).schema.names

    def run(texts, spans):
        done = [finish(t or "", merged(s)) for t, s in zip(texts, spans, strict=True)]
        return {name: [d[i] for d in done] for i, name in enumerate(names)}

    return base.with_columns(joined, ["_text", "spans"], run, columns, keep)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the repeated parts of its texts removed; a text that loses all of its characters goes with its row."""
    others = [c for c in df.columns if c != text]
    left = with_removals(df, lambda t, r: (kept_text(t, r), bool(r)), "kept STRING, touched BOOLEAN", df.columns, key, text)
    return left.where((F.col("kept") != "") | ~F.col("touched")).select(*others, F.when(F.col("touched"), F.col("kept")).otherwise(F.col(text)).alias(text)).select(*df.columns)
