"""Pack token pieces into sequences: exact complements first, best fit for what is left."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.ordered import sliced_row_number
from docloom.llm import base

#: ASCII marks: the tokenizer takes a run of them as one.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Words that one worker remembers before it starts anew.
WORDS = 800_000
#: Words of letters that go to the tokenizer as one text.
TOGETHER = 1000
PIECES = "piece INT, start LONG, length LONG, ids_crc32 LONG"


def _letters(word: bytes) -> bool:
    """Whether the word is letters only, in any case and form the tokenizer may give it.

    Beyond Latin letters, and for the dotted capital I, composing and lower-casing can bring marks in.
    """
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Texts to their ids, as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, so a word between ASCII white
    space has the same ids in any text. Words are remembered; those that some texts have and the
    memory has not go to the tokenizer in one call.
    """
    import os

    import numpy as np

    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def alone(some: list[bytes]) -> list[bytes]:
        coded = tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def side_by_side(some: list[bytes]) -> list[bytes]:
        """Words of letters only, encoded as one text: a word is one pre-token, so its last id tells where it ends."""
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(ends_word[ids]) + 1) * 4).tolist()
        if len(ends) != len(some):
            return alone(some)
        coded = ids.tobytes()
        return [coded[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    words: dict[bytes, bytes] = {}

    def learn(fresh: set[bytes]) -> None:
        """Put words into the memory, by way of simpler ones that have the same ids one after another.

        The tokenizer lower-cases too, and marks after letters are a token of their own. Names of special
        tokens stay as they are.
        """
        heads, tails, lettered, others = [], [], set(), {b""}
        for w in fresh:
            low = w.lower() if b"<|" not in w else w
            head = low.rstrip(_MARKS)
            if head and _letters(head):
                lettered.add(head)
            else:
                head = low
                others.add(head)
            heads.append(head)
            tails.append(low[len(head):])
        others.update(tails)
        todo = list(lettered.difference(words))
        known: dict[bytes, bytes] = {}
        for lo in range(0, len(todo), TOGETHER):
            known.update(zip(todo[lo:lo + TOGETHER], side_by_side(todo[lo:lo + TOGETHER]), strict=True))
        todo = list(others.difference(words))
        known.update(zip(todo, alone(todo), strict=True))
        words.update(known)
        words.update(zip(fresh, [words[h] + words[t] for h, t in zip(heads, tails, strict=True)], strict=True))

    def encode(texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        if len(words) >= WORDS:
            words.clear()
        learn(set().union(*split).difference(words))
        return [b"".join(map(words.__getitem__, ws)) for ws in split]

    return encode


def _by_bytes(texts: list[str], most: int = 1 << 22):
    """Runs of texts of about ``most`` characters together, so that long ones do not meet in memory."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


def token_pieces(df: DataFrame, tokenizer: str, capacity: int, keep: list[str], text: str = "text", end_id: int = 1) -> DataFrame:
    """Per document one row per piece of at most ``capacity`` ids, with ``keep``, piece, start, length, ids_crc32.

    A document is its ids and ``end_id``; only longer ones are cut, so an empty or null text is one
    piece of one id.
    """
    out_schema = StructType([*df.select(*keep).schema, *df.sparkSession.createDataFrame([], PIECES).schema])

    def cut(batch):
        encode = _encoder(tokenizer)
        base.remembers(__name__, _encoder.cache_clear)
        out: dict[str, list] = {name: [] for name in [*keep, "piece", "start", "length", "ids_crc32"]}
        end, step = end_id.to_bytes(4, "little"), capacity * 4
        for i, ids in ((lo + j, ids + end) for lo, some in _by_bytes(batch["_text"]) for j, ids in enumerate(encode(some))):
            for piece, at in enumerate(range(0, len(ids), step)):
                part = ids[at:at + step]
                for name in keep:
                    out[name].append(batch[name][i])
                out["piece"].append(piece)
                out["start"].append(at // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
        yield out

    return base.per_batch(df.select(*keep, base.whole(F.col(text)).alias("_text")), cut, out_schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for ``counts`` pieces of each length, as (lengths, how many such sequences).

    Exact complements up to triples, then best fit. Triples may use up small pieces that would fill
    the gaps of large ones, so plans with complements of fewer lengths, and one of best fit alone,
    are made too, and the one with the fewest sequences is taken.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda made: sum(times for _, times in made))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """First combinations of up to ``most`` lengths that fill a sequence exactly, as many as are
    available; pairs and triples that hold the longest pieces go first. What is left goes, longest
    first, to the fullest open sequence that still has room. Works on lengths, of which there are at
    most ``capacity``, and never on pieces; every step uses up a length or a kind of open sequence.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    made: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...]) -> None:
        need = Counter(combo)
        times = min(left[n] // k for n, k in need.items())
        if times > 0:
            made.append((combo, times))
            for n, k in need.items():
                left[n] -= times * k

    use((capacity,))
    for a in range(capacity - 1, (capacity + 1) // 2 - 1, -1) if most > 1 else ():
        if left[a] and left[capacity - a]:
            use((a, capacity - a))
    for a in range(capacity - 2, (capacity + 2) // 3 - 1, -1) if most > 2 else ():
        if not left[a]:
            continue
        rest = capacity - a
        for b in range(min(a, rest - 1), (rest + 1) // 2 - 1, -1):
            if not left[a]:
                break
            if left[b] and left[rest - b]:
                use((a, b, rest - b))
    # Best fit: open sequences by their gap; each kind of open sequence has a multiplicity.
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(combo: tuple[int, ...], times: int, gap: int) -> None:
        if gap == 0:
            made.append((combo, times))
            return
        if gap not in open_by_gap:
            open_by_gap[gap] = []
            bisect.insort(gaps, gap)
        open_by_gap[gap].append((combo, times))

    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n  # a new sequence takes as many of this length as it holds
                full, rest = divmod(todo, each)
                if full:
                    put((n,) * each, full, capacity - n * each)
                if rest:
                    put((n,) * rest, 1, capacity - n * rest)
                break
            gap = gaps[at]
            combo, times = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap]
                gaps.pop(at)
            each = min(gap // n, todo)
            used = min(times, todo // each)
            put(combo + (n,) * each, used, gap - n * each)
            if times > used:
                put(combo, times - used, gap)
            todo -= used * each
    made.extend(x for kinds in open_by_gap.values() for x in kinds)
    return made


def places(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the pieces of each length and rank go."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for combo, times in made:
        offset = 0
        for n in combo:
            rows.append((n, rank[n], times, sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int, order: list[str], slices: int = 64, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless from 0 in sequences of at most ``capacity``.

    Only counts per length (at most ``capacity`` rows) reach the driver, and the plan that goes out
    has a size bounded by ``capacity`` alone. Pieces are numbered within their length; a length that
    a third of all pieces share is numbered in ``slices`` by hash. ``order`` tells pieces apart.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    rows = places(plan(counts, capacity))
    slots = spark.createDataFrame(rows, "_n LONG, _from LONG, _times LONG, _sequence LONG, _offset LONG")
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    ranked = sliced_row_number(sliced, [length], "_slice", order, "_rank").withColumn("_rank", F.col("_rank") - 1)
    return (ranked.join(F.broadcast(slots), (F.col(length) == F.col("_n")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_times")))
            .withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from")).withColumn("offset", F.col("_offset"))
            .drop("_slice", "_rank", "_n", "_from", "_times", "_sequence", "_offset"))
