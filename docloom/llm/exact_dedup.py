"""Exact duplicates through an extendible-hash index in shared files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from docloom.llm import base
from docloom.llm.ordering import HOT_SHARE, look_up, small_or_not

#: Bits of a hash key, and keys that a bucket holds before it splits.
BITS, CAPACITY = 60, 512
#: Result columns of :func:`duplicates`.
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def directory(keys: DataFrame, bits: int = BITS, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``(slot, bucket, depth)`` of an extendible hash over ``keys(_hash)``, one row per key, and its depth.

    A slot is a key's first ``g`` bits. A bucket is named by the first key of its range; its depth
    says how many bits its keys share, and 2 ** (g - depth) slots point to it. While a bucket holds
    more than ``capacity`` keys it splits at its next bit, and the directory doubles. Only keys of
    overfull buckets are counted again. Building begins at the depth below which some bucket must
    overflow, so a few rounds do. Equal keys are one entry: copies of a text never split a bucket.
    """
    g = min(bits, max(0, (max(1, keys.count()) - 1) // capacity).bit_length())
    done, within = [], keys.select("_hash")
    while True:
        prefix = F.shiftright("_hash", bits - g)
        cells = base.stored(within.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("fill")), "buckets")
        full = (F.col("fill") > capacity) & F.lit(g < bits)
        done.append(cells.where(~full).select("prefix", F.lit(g).alias("depth")))
        over = cells.where(full).select(F.col("prefix").alias("_over"))
        if not over.head(1):
            break
        within = within.join(small_or_not(over), prefix == F.col("_over"), "left_semi")
        g += 1
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.union(more)
    slots = F.expr(f"sequence(shiftleft(prefix, {g} - depth), shiftleft(prefix + 1, {g} - depth) - 1)")
    return buckets.select(F.explode(slots).alias("slot"), F.expr(f"shiftleft(prefix, {bits} - depth)").alias("bucket"), "depth"), g


def _chained(batches: Iterator[pa.RecordBatch], key: list[str], text: str, head: str | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key`` with their ``_link``: the place of their text in the chain of the key's distinct texts.

    A key's chain is held while its rows pass: one text, unless hashes collide. Rows without a text
    have link 0. With ``head``, that column marks keys whose chains are met again elsewhere: the
    first row of each link keeps its text, all other texts are dropped here.
    """
    current, chain = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            keys = list(zip(*[part.column(k).to_pylist() for k in key], strict=True))
            again = part.column(head).to_pylist() if head else [False] * len(keys)
            links, heads = [], []
            for k, t, more in zip(keys, part.column(text).to_pylist(), again, strict=True):
                if k != current:
                    current, chain = k, []
                link = 0 if t is None else next((i for i, known in enumerate(chain) if known == t), len(chain))
                new = t is not None and link == len(chain)
                if new:
                    chain.append(t)
                links.append(link)
                heads.append(t if new and more else None)
            rest = [c for c in part.schema.names if c != text]
            made = [pa.array(links, pa.int32()), *([pa.array(heads, pa.string())] if head else [])]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *made], names=[*rest, "_link", *(["_head"] if head else [])])


def _chains(df: DataFrame, key: list[str], head: str | None = None) -> DataFrame:
    fields = [f for f in df.schema if f.name != "_text"] + [StructField("_link", IntegerType())] + ([StructField("_head", StringType())] if head else [])
    return df.sortWithinPartitions(*key).mapInArrow(lambda batches: _chained(batches, key, "_text", head), StructType(fields))


def duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, bits: int = BITS, capacity: int = CAPACITY) -> DataFrame:
    """Every row of ``df``: ``keep`` columns (default ``key``), keep_id, group_size, kept and text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts one row stays, that
    of the largest ``key`` (null is the smallest); of rows that repeat key and text too, exactly one.
    ``keep_id`` is the key of the row that stays. An empty table gives an empty one. A kept column
    named like a result column gives way to it; other columns of ``df`` may have any name.

    1. Hashes (60 bits of SHA-256) are counted and put into an extendible-hash directory.
    2. Texts whose hash no other row has are done and stay where they are. The others go to the
       task that owns their bucket, a range of keys, where equal hashes are chained and texts are
       compared byte by byte. Keys that hold much of the table are dealt over several tasks, whose
       chains of distinct texts then meet once more.
    3. Group sizes and the row that stays are summed up per link of a chain and looked up again.
    """
    keep = [c for c in (keep if keep is not None else [key]) if c.lower() not in RESULT]
    whole = base.whole(F.col(f"`{text}`"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("_row"), F.col(f"`{key}`").alias("_id"), whole.alias("_text"), F.sha2(whole.cast("binary"), 256).alias("_sha"))
    rows = rows.withColumn("_hash", F.shiftright(F.conv(F.substring("_sha", 1, BITS // 4), 16, 10).cast("long"), BITS - bits))

    keys = base.stored(rows.groupBy("_hash").agg(F.count("*").alias("_rows")), "hashes")
    total = keys.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    slots, depth = directory(keys, bits, capacity)
    shared = keys.where("_rows > 1")
    owned = shared.join(small_or_not(slots), F.shiftright("_hash", bits - depth) == F.col("slot")).select(
        "_hash", "bucket", F.ceil(F.col("_rows") * HOT_SHARE / F.lit(max(1, total))).alias("_salts"))
    owned = base.stored(owned, "index")

    # A third of all rows may share one hash: hashes are looked up by broadcast while few are shared, else by an adaptive join.
    met = rows.join(small_or_not(owned), "_hash", "left")
    met = met.select(
        "_row", "_id", "_sha", "_hash", F.coalesce("bucket", F.col("_hash")).alias("_bucket"), (F.col("_salts") > 1).alias("_again"),
        F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), "_salts")).otherwise(F.lit(0)).alias("_salt"),
        F.col("bucket").isNotNull().alias("_met"), F.when(F.col("bucket").isNotNull(), F.col("_text")).alias("_text"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = base.stored(_chains(met.repartition(partitions, "_bucket", "_salt"), ["_hash", "_salt"], "_again").withColumn("_at", F.monotonically_increasing_id()), "links")

    # First texts of links of dealt keys: at most twice HOT_SHARE of them, and one more for every collision.
    heads = links.where(F.col("_head").isNotNull()).select("_hash", "_salt", F.col("_link").alias("_local"), F.col("_head").alias("_text"))
    merged = _chains(heads.repartition("_hash"), ["_hash"]).withColumnRenamed("_link", "_merged")
    found = links.where("_met").drop("_head").join(
        small_or_not(merged.select("_hash", "_salt", F.col("_local").alias("_link"), "_merged")), ["_hash", "_salt", "_link"], "left")
    found = base.stored(found.select("_row", "_id", "_sha", "_hash", F.coalesce("_merged", "_link").alias("_class"), "_at"), "classes")
    groups = found.groupBy("_hash", "_class").agg(F.max(F.struct("_id", "_at")).alias("_best"), F.count("*").alias("_size"))
    several = look_up(found, base.stored(groups, "groups"), ["_hash", "_class"], "_size", total).select(
        "_row.*", F.col("_best._id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_best._at") == F.col("_at")).alias("kept"), F.col("_sha").alias("text_sha256"))
    single = links.where("NOT _met").select("_row.*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    return single.unionByName(several).select(*keep, *RESULT)
