"""Secrets by pattern, and by how many owners hold the same candidate."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docloom.llm import base

# Fixed patterns: the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: The same runs as HEX finds, but only those long enough: a run ends where its characters do.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: What a word of random-looking key material is made of; held against entropy below.
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "opaque")
#: A candidate of at most so many owners is taken for a live credential of its owner, however many of the owner's repositories hold it.
OWNERS = 1
_SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("hash", StringType())])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of kind, end, value) of the base kinds; start and end hold the whole match."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m[0]) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def looks_random(s: str) -> bool:
    """Digits and letters together, few repeats: key material rather than a word, name or path."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and _entropy(s) >= 3.5


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """The base spans, and opaque words that touch none of them."""
    found = base_spans(text)
    taken = [(s, e) for s, _, e, _ in found]
    for m in _OPAQUE.finditer(text):
        if looks_random(m[0]) and all(m.end() <= s or e <= m.start() for s, e in taken):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``found``, an array of (kind, start, end, hash) by start, then kind. Values leave as hashes only."""

    def run(texts):
        return {"found": [[{"kind": KINDS[k], "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in candidates(t or "")] for t in texts]}

    return base.with_columns(df, [text], run, StructType([StructField("found", ArrayType(_SPAN))]), keep)


def ownership(scanned: DataFrame, owner: list[str], repository: list[str]) -> DataFrame:
    """hash, owners, repositories: over the whole corpus, who holds each candidate and in how many places.

    A repository belongs to an owner, so the same repository columns under two owners are two. Repositories are
    counted per owner and then added up over owners, so a value that a third of all rows hold is reduced in every
    task before it is sent. A null owner or repository is one of its own.
    """
    held = scanned.select(F.to_json(F.struct(*owner)).alias("o"), F.to_json(F.struct(*repository)).alias("r"), F.explode("found.hash").alias("hash")).distinct()
    per_owner = held.groupBy("hash", "o").agg(F.count("*").alias("n"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def find(df: DataFrame, keep: list[str], owner: list[str], repository: list[str], text: str = "text") -> DataFrame:
    """Per row ``keep``, ``base`` and ``live``: arrays of (kind, start, end) by start, then kind; and ``repositories``.

    ``base`` holds every base span. ``live`` holds the candidates of any kind whose value only one
    owner has: these look live, while a value that many owners have is a copied example.
    ``repositories`` says for each of ``live`` in how many of its owner's repositories the value lies:
    beyond one, the owner copied the secret or uses it again. However many there are, an owner's copies do not make an
    example. An opaque candidate counts as a secret only if it is live. Positions are code points, ends exclusive.
    A null text is empty, repeated rows stay repeated, an empty table gives an empty one.
    """
    # A row number told apart only within this stored table, so rows may repeat.
    held = list(dict.fromkeys([*keep, *owner, *repository]))
    scanned = base.stored(scan(df, held, text).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    live = ownership(scanned.where(F.size("found") > 0), owner, repository).where(F.col("owners") <= OWNERS).select("hash", "repositories")
    spans = scanned.where(F.size("found") > 0).select("_row", F.explode("found").alias("s")).select("_row", "s.*")
    chosen = spans.join(live, "hash").groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end", "repositories")).alias("_live"))
    order = F.array(*[F.lit(k) for k in KINDS])
    listed = F.array_sort(F.transform("_live", lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["kind"], s["end"], s["repositories"])))
    tidy = F.transform(listed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    places = F.transform(listed, lambda s: s["repositories"])
    rows = scanned.join(chosen, "_row", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    first = F.transform(F.filter("found", lambda s: s["kind"] != "opaque"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*keep, first.alias("base"), F.coalesce(tidy, none).alias("live"),
                       F.coalesce(places, F.array().cast("array<bigint>")).alias("repositories"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_spans() -> Column:
    """Base spans and live opaque ones, by start, then kind."""
    extra = F.filter("live", lambda s: s["kind"] == "opaque")
    return F.array_sort(F.concat("base", extra), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), a["kind"]).cast("int") - F.array_position(F.array(*[F.lit(k) for k in KINDS]), b["kind"]).cast("int")))


def redact(text: str, spans, mark: str = "[secret]") -> str:
    """``text`` with every span replaced; spans that touch or overlap become one mark."""
    runs: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    out, at = [], 0
    for start, end in runs:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]
