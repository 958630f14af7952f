"""Repair of conversation structure over a suffix-shared automaton of role and fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docloom.llm import base
from docloom.llm.ordering import look_up, ranked, told_apart

# The fault patterns and what edits cost.
BLANK = "\\A[\\x20\\x09-\\x0D]*\\z"
ENDED = "[.!?][\\x20\\x09-\\x0D]*\\z"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Rows of a conversation whose signature is one word; a longer conversation is cut into words of so many rows, counted from its end.
WORD = 256
#: Grammar states: nothing yet, after s, after u, after a. Each with what may follow: initial and next state. 0 and 3 may end.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: What an edit may write in each state: never a system row.
WRITES = tuple(next(i for i in f if i != "s") for f in FOLLOWS)
NAMES = {"u": "user", "a": "assistant"}
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

_STATES = range(len(FOLLOWS))
#: Per state the cost of the cheapest edits to the end and their initials; None where there is no way.
Best = tuple


def _inserted(best: list) -> Best:
    """Cheapest ways when rows may be inserted first: two insertions reach every state there is to reach."""
    for _ in range(3):
        for s in _STATES:
            after = best[FOLLOWS[s][WRITES[s]]]
            if after is not None:
                way = (after[0] + INSERT, "I" + after[1])
                if best[s] is None or way < best[s]:
                    best[s] = way
    return tuple(best)


def at_end(states: tuple[int, ...]) -> Best:
    """The empty suffix: no edits where a conversation may end, else insertions."""
    return _inserted([(0, "") if s in states else None for s in _STATES])


def before(symbol: str, after: Best) -> Best:
    """Cost-to-go and best audit suffix of a node, from those of the node that its symbol leads to.

    ``symbol`` is ``x`` for a row that must go, else its role's initial (``o``: none of the three),
    upper-case if the row is truncated. Edits are compared by cost, then by their initials.
    """
    best: list = []
    extra, initial = TRUNCATED if symbol.isupper() else 0, symbol.lower()
    for s in _STATES:
        ways = [] if after[s] is None else [(after[s][0] + DELETE, "D" + after[s][1])]
        if symbol != "x":
            to = FOLLOWS[s].get(initial)
            if to is not None and after[to] is not None:
                ways.append((after[to][0] + extra, "K" + after[to][1]))
            to = FOLLOWS[s][WRITES[s]]
            if initial != WRITES[s] and after[to] is not None:
                ways.append((after[to][0] + REROLE + extra, "R" + after[to][1]))
        best.append(min(ways) if ways else None)
    return _inserted(best)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted from their ends, so words that share a suffix follow each other: the automaton, one path at a time.

    The path holds the nodes of the current word's suffixes, the empty one first. Of the next word
    only the part before the shared suffix makes new nodes; each is worked out once per grammar
    state, for every conversation and place that has the suffix. A word that ends its conversation
    is worked out towards the accepting states, one that goes on towards each of the four.
    """
    path: list[list[Best]] = []
    symbols, last_kind = "", None
    for batch in batches:
        tables = []
        for reverse, ends in zip(batch.column("reverse").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if ends != last_kind:
                path, symbols, last_kind = [[at_end(t) for t in ([ENDS] if ends else [(s,) for s in _STATES])]], "", ends
            shared = 0
            while shared < min(len(symbols), len(reverse)) and symbols[shared] == reverse[shared]:
                shared += 1
            del path[shared + 1:]
            for symbol in reverse[shared:]:
                path.append([before(symbol, after) for after in path[-1]])
            symbols = reverse
            tables.append([[None if way is None else {"cost": way[0], "audit": way[1]} for way in best] for best in path[-1]])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(tables, pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))))],
            names=[*batch.schema.names, "table"])


_TABLE = ArrayType(ArrayType(StructType([StructField("cost", LongType()), StructField("audit", StringType())])))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each long conversation, sorted from its end, taken together: ``_g``, cost, audit."""
    current, best = None, None

    def done():
        return pa.RecordBatch.from_pydict({"_g": [current], "cost": pa.array([best[0][0]], pa.int64()), "audit": [best[0][1]]})

    for batch in batches:
        for g, table in zip(batch.column("_g").to_pylist(), batch.column("table").to_pylist(), strict=True):
            ways = [[None if w is None else (w["cost"], w["audit"]) for w in row] for row in table]
            if g != current:
                if best is not None:
                    yield done()
                current, best = g, ways[0]
                continue
            # ways[t][s]: from state s to state t over the earlier word; best[t]: from there to the end.
            best = [min(((ways[t][s][0] + best[t][0], ways[t][s][1] + best[t][1]) for t in _STATES if ways[t][s] and best[t]), default=None) for s in _STATES]
    if best is not None:
        yield done()


def cheapest_edits(words: DataFrame) -> DataFrame:
    """``(_g, cost, audit)`` for ``words(_g, word, reverse)``: word 0 ends a conversation; ``reverse`` is read from its end.

    Distinct words are dealt by range of their reversed symbols, so each suffix is met in one task
    (two where a range border parts it). A word that a third of all conversations share is worked
    out once and goes out to them.
    """
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = words.withColumn("ends", F.col("word") == 0)
    distinct = base.stored(words.groupBy("ends", "reverse").agg(F.count("*").alias("_uses")), "words")
    schema = StructType([*distinct.schema, StructField("table", _TABLE)])
    tables = base.stored(distinct.repartitionByRange(partitions, "ends", "reverse").sortWithinPartitions("ends", "reverse").mapInArrow(_solved, schema), "automaton")
    total = distinct.agg(F.coalesce(F.sum("_uses"), F.lit(0))).first()[0]
    found = look_up(words, tables, ["ends", "reverse"], "_uses", total)
    long = words.where("word > 0").select("_g").distinct()
    short = found.join(long, "_g", "left_anti").select("_g", F.expr("table[0][0].cost").alias("cost"), F.expr("table[0][0].audit").alias("audit"))
    parts = found.join(long, "_g", "left_semi").select("_g", "word", "table").repartition("_g").sortWithinPartitions("_g", "word")
    return short.unionByName(parts.mapInArrow(_composed, "_g STRING, cost LONG, audit STRING"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, the audit first: digests of the repaired rows, one row at a time."""
    current, audit, at, state, sha, lines = None, "", 0, 0, None, 0

    def write(role: str, text: str, initial: str):
        nonlocal state, lines
        sha.update((("\n" if lines else "") + role + ":" + text).encode())
        state, lines = FOLLOWS[state][initial], lines + 1

    def insertions():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            write(NAMES[WRITES[state]], "", WRITES[state])
            at += 1

    def done(ids, digests):
        if current is not None:
            insertions()
            ids.append(current)
            digests.append(sha.hexdigest())

    def out(ids, digests):
        return pa.RecordBatch.from_pydict({"_g": pa.array(ids, pa.string()), "repaired_sha256": pa.array(digests, pa.string())})

    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part, ids, digests = batch.slice(lo, 500), [], []
            for g, role, text, plan in zip(*[part.column(c).to_pylist() for c in ("_g", "_role", "_text", "audit")], strict=True):
                if plan is not None:
                    done(ids, digests)
                    current, audit, at, state, sha, lines = g, plan, 0, 0, hashlib.sha256(), 0
                    continue
                insertions()
                edit, at = audit[at], at + 1
                if edit == "K":
                    write(role, text, role[0])
                elif edit == "R":
                    write(NAMES[WRITES[state]], text, WRITES[state])
            if ids:
                yield out(ids, digests)
    ids, digests = [], []
    done(ids, digests)
    if ids:
        yield out(ids, digests)


def repair(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role, then by digest of role and text.
    A null role or text is one space; a null conversation is one of its own. Blank rows and rows whose
    role and text came before must be deleted; a row that ends in none of ``.!?`` is truncated. The
    cheapest edits (keep 0, change role 2, delete 3, insert an empty row 2, one more for a truncated
    row that stays) that leave ``(s?(ua)+)?`` as initials of the roles are ``audit``; of equally cheap
    ones the least string. ``gaps`` counts the turns missing between the first and the last.

    ``every``, a table with the conversation column, may name conversations of which no row is left:
    zeros, an empty audit, the digest of nothing. An empty table gives an empty one. Other columns of
    ``df`` may have any name. ``turn`` is an integer.

    Texts move once, to be digested in order as they stream by. All else works on a few bytes a row:
    ranks from the end by a range shuffle that may split a conversation, then one signature symbol a
    row in words of ``WORD`` symbols. The audit of a conversation is one value and its digest one
    pass, so these two are made by one task each, in memory of the audit and one row.
    """
    column = lambda c: F.col(f"`{c}`")
    space = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    rows = df.select(column(conversation).alias("_id"), told_apart(column(conversation)).alias("_g"), column(turn).cast("long").alias("_turn"), space(role).alias("_role"), space(text).alias("_text"))
    rows = rows.withColumn("_same", F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text")).cast("binary"), 256))
    first = F.substring("_role", 1, 1)
    narrow = rows.select(
        "_g", "_turn", "_role", "_same", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("_as"),
        F.col("_text").rlike(BLANK).alias("_blank"), (~F.col("_text").rlike(ENDED)).alias("_cut"))

    # _rank counts from the end: the last row of a conversation has 0.
    back = [F.desc_nulls_last("_turn"), F.desc("_role"), F.desc("_same")]
    placed = ranked(narrow, back, "turns")
    # A text's first row is looked up by its place too, so copies of one row do not meet in one task.
    firsts = placed.groupBy("_g", "_same").agg(F.max("_rank").alias("_rank")).withColumn("_new", F.lit(True))
    judged = placed.join(firsts, ["_g", "_same", "_rank"], "left").select(
        "_g", "_turn", "_rank", "_as", "_blank", (~F.col("_blank") & F.col("_new").isNull()).alias("_double"), (~F.col("_blank") & F.col("_new").isNotNull() & F.col("_cut")).alias("_cut"))
    symbol = F.when(F.col("_blank") | F.col("_double"), "x").when(F.col("_cut"), F.upper("_as")).otherwise(F.col("_as"))
    judged = base.stored(judged.withColumn("_symbol", symbol), "judged")

    # The row that ends a word is also seen by the word after it, for the pair of roles between them.
    place = F.struct(F.expr(f"_rank div {WORD}").alias("word"), F.lit(True).alias("own"))
    seen = F.when((F.col("_rank") % WORD == 0) & (F.col("_rank") > 0), F.array(place, F.struct(F.expr(f"_rank div {WORD} - 1").alias("word"), F.lit(False).alias("own")))).otherwise(F.array(place))
    each = judged.select("*", F.explode(seen).alias("in"))
    own = F.col("in.own")
    words = each.groupBy("_g", F.col("in.word").alias("word")).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "_as", F.when(own, F.col("_symbol")).alias("_symbol")))).alias("rows"),
        F.count_if(own & F.col("_blank")).alias("blank"), F.count_if(own & F.col("_double")).alias("duplicate"), F.count_if(own & F.col("_cut")).alias("truncated"))
    roles = F.array_join(F.transform("rows", lambda r: r["_as"]), "")  # from the end: a pair reads backwards
    legal = F.regexp_count(roles, F.lit("(?=us|au|ua)"))
    words = base.stored(words.select(
        "_g", "word", "blank", "duplicate", "truncated", (F.size("rows") - 1 - legal).cast("long").alias("illegal"),
        F.array_join(F.transform("rows", lambda r: r["_symbol"]), "").alias("reverse")), "signatures")
    turns = judged.groupBy("_g").agg(F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.countDistinct("_turn"), F.lit(0)).cast("long").alias("gaps"))
    counts = words.groupBy("_g").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    edits = base.stored(cheapest_edits(words.select("_g", "word", "reverse")), "edits")

    none = lambda kind: F.lit(None).cast(kind)
    plans = edits.select("_g", none("long").alias("_turn"), none("string").alias("_role"), none("string").alias("_same"), none("string").alias("_text"), "audit")
    texts = rows.select("_g", "_turn", "_role", "_same", "_text", none("string").alias("audit"))
    stream = texts.unionByName(plans).repartition("_g").sortWithinPartitions("_g", F.col("audit").isNull(), F.asc_nulls_first("_turn"), "_role", "_same")
    digests = stream.mapInArrow(_digests, "_g STRING, repaired_sha256 STRING")

    ids = df.select(column(conversation)) if every is None else df.select(column(conversation)).union(every.select(column(conversation)))
    out = ids.distinct().withColumn("_g", told_apart(column(conversation)))
    for part in (turns, counts, edits, digests):
        out = out.join(part, "_g", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(column(conversation), *[zero(c) for c in RESULT[:6]], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damage(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns with known faults: by the checksum of ``conversation:turn`` a row is dropped, emptied, robbed of its
    sentence ends, repeated, or given to the user. Nulls become one space, in roles and texts too."""
    column = lambda c: F.col(f"`{c}`")
    said = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conversation), F.lit(":"), said(turn)).cast("binary")) % 20
    rows = df.select(column(conversation), column(turn), said(role).alias(role), said(text).alias(text), kind.alias("_kind")).where("_kind <> 0")
    changed = rows.select(
        column(conversation), column(turn), F.when(F.col("_kind") == 4, "user").otherwise(column(role)).alias(role),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(column(text), ".!?", "")).otherwise(column(text)).alias(text),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return changed.drop("_copy")
