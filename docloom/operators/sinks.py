"""Upserts, exports, record shaping, routing and table maintenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import remove_work, write_work


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``, ties and no order decided by the row's content."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    content = F.to_json(F.struct(*rest))
    last = F.max_by(F.struct(*rest), F.struct(*order, content))
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def merge_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Upsert by full outer join: incoming values win for ``update``, all other columns stay.

    Of several incoming rows of one key the last by ``order`` counts. ``action`` says per row
    whether it was inserted, updated or kept.
    """
    incoming = latest_rows(incoming, keys, order)
    old = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("old"))
    new = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("new"))
    rest = [c for c in existing.columns if c not in keys]
    has = set(incoming.columns)

    def value(c: str) -> Column:
        if c not in has:
            return F.col(f"old.{c}")
        taken = F.col(f"new.{c}")
        if c in update:
            return F.when(F.col("new").isNotNull(), taken).otherwise(F.col(f"old.{c}"))
        return F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(taken)

    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").otherwise("updated")
    return old.join(new, list(keys), "full_outer").select(*keys, *[value(c).alias(c) for c in rest], action.alias("action"))


def _layout(spark: SparkSession, path: str, buckets: int | None) -> int:
    """The bucket count that is stored beside the table; another one is an error."""
    place = f"{path}/_layout"
    try:
        stored = spark.read.schema("buckets INT").json(place).first()["buckets"]
    except Exception as error:  # noqa: BLE001 - a missing path means a new table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = buckets or 64
        spark.createDataFrame([(stored,)], "buckets INT").coalesce(1).write.json(place)
    if buckets not in (None, stored):
        raise ValueError(f"the table has {stored} buckets, not {buckets}")
    return stored


def upsert_table(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], update: Sequence[str], buckets: int | None = None,
    order: Sequence[str] = (), replace: Sequence[str] = (),
) -> DataFrame:
    """Upsert into a Parquet table partitioned by a hash bucket of the first key.

    The bucket count (64 unless given) is fixed when the table is made. Only buckets that receive
    rows are read and rewritten. The merged rows are first written to the shared folder, so a lost
    executor never leaves a half-read, half-overwritten bucket; those work tables are removed.
    ``replace`` names keys, the first one among them, whose incoming groups replace the stored ones:
    rows of a group that do not come again go. Returns the counts of inserted, updated, kept and
    removed rows in the buckets.
    """
    if replace and replace[0] != keys[0]:
        raise ValueError("groups are replaced within buckets, so the first key must lead them")
    number = _layout(spark, path, buckets)
    bucket = F.pmod(F.xxhash64(keys[0]), F.lit(number)).cast("int")
    incoming_path = write_work(incoming.withColumn("bucket", bucket), "incoming")
    staged = spark.read.parquet(incoming_path)
    try:
        table = spark.read.parquet(path)
        touched = table.join(staged.select("bucket").distinct(), "bucket", "left_semi")
    except Exception as error:  # noqa: BLE001 - a missing path means a new table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        touched = spark.createDataFrame([], staged.schema)
    merged = merge_rows(touched, staged, [*keys, "bucket"], update, order)
    if replace:
        again = staged.select(*replace).distinct().withColumn("_again", F.lit(True))
        stale = (F.col("action") == "kept") & F.col("_again").isNotNull()
        merged = merged.join(again, list(replace), "left").withColumn("action", F.when(stale, "removed").otherwise(F.col("action"))).drop("_again")
    merged_path = write_work(merged, "merged")
    result = spark.read.parquet(merged_path)
    (
        result.where("action <> 'removed'").drop("action").repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(8))).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )
    counts = [tuple(r) for r in result.groupBy("action").agg(F.count("*").alias("n")).collect()]
    remove_work(spark, incoming_path, merged_path)
    return spark.createDataFrame(counts, "action STRING, n LONG")


def export(df: DataFrame, path: str, fmt: str, include_text: bool = True, include_metadata: bool = True,
           text: Sequence[str] = ("content",), metadata: Sequence[str] = ("metadata",)) -> None:
    """Write as json, jsonl, ndjson, csv or parquet, with or without text and metadata columns."""
    drop = [*(() if include_text else text), *(() if include_metadata else metadata)]
    out = df.drop(*drop)
    if fmt in ("json", "jsonl", "ndjson"):
        out.write.json(path)
    elif fmt == "csv":
        nested = [f.name for f in out.schema.fields if f.dataType.typeName() in ("map", "array", "struct")]
        for c in nested:
            out = out.withColumn(c, F.to_json(c))
        out.write.csv(path, header=True)
    elif fmt == "parquet":
        out.write.parquet(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def vector_records(chunks: DataFrame, max_content: int | None = None) -> DataFrame:
    """Records for a vector store: id ``job_chunk_i``, values and metadata with scalar extras only.

    ``chunks(job_id, chunk_index, content, embedding, metadata)`` where ``metadata`` maps names to
    JSON values; arrays and objects are left out. Content is whole unless ``max_content`` cuts it.
    """
    scalars = F.map_filter("metadata", lambda _, v: v.isNotNull() & ~v.startswith("[") & ~v.startswith("{"))
    own = F.create_map(
        F.lit("job_id"), F.col("job_id").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string"),
        F.lit("content"), F.col("content") if max_content is None else F.left("content", F.lit(max_content)))
    free = F.map_filter(scalars, lambda k, _: ~k.isin("job_id", "chunk_index", "content"))
    return chunks.select(
        F.concat(F.col("job_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"),
        F.col("embedding").alias("values"), F.map_concat(own, free).alias("metadata"))


def property_graph(chunks: DataFrame, documents: DataFrame, entity_fields: Sequence[str] = ("title", "author", "organization"),
                   max_content: int | None = None, max_name: int | None = None, entity_chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables for a property graph store.

    Documents, with their other columns as JSON in ``metadata``, their chunks, ``HAS_CHUNK`` and ``NEXT_CHUNK`` edges, and for the first
    ``entity_chunks`` chunks the entities named in the document's metadata fields. Texts and names
    are whole and all chunks get entities unless the limits say otherwise.
    """
    cut = lambda c, most: c if most is None else F.left(c, F.lit(most))
    cid = lambda i: F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), i.cast("string"))
    own = cid(F.col("chunk_index"))
    doc_nodes = documents.select(F.col("doc_id").cast("string").alias("id"), F.lit("Document").alias("label"), F.lit(None).cast("string").alias("content"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "doc_id"])).alias("metadata"))
    chunk_nodes = chunks.select(own.alias("id"), F.lit("Chunk").alias("label"), cut(F.col("content"), max_content).alias("content"))
    present = [f for f in entity_fields if f in documents.columns]
    named = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("kind"), cut(F.col(f).cast("string"), max_name).alias("name"))) for f in present]))
    about = documents.select("doc_id", F.explode(named).alias("e"))
    entities = (chunks if entity_chunks is None else chunks.where(F.col("chunk_index") < entity_chunks)).select("doc_id", own.alias("chunk")).join(about, "doc_id").select(
        "chunk", F.concat(F.col("chunk"), F.lit("_ent_"), F.col("e.kind")).alias("id"), F.col("e.name").alias("name"))
    nodes = doc_nodes.unionByName(chunk_nodes, allowMissingColumns=True).unionByName(entities.select("id", F.lit("Entity").alias("label"), F.col("name").alias("content")), allowMissingColumns=True)
    following = F.lead("chunk_index").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    edge = lambda df, s, d, kind: df.select(s.alias("src"), d.alias("dst"), F.lit(kind).alias("type"))
    edges = (
        edge(chunks, F.col("doc_id").cast("string"), own, "HAS_CHUNK")
        .unionByName(edge(chunks.withColumn("next", following).where(F.col("next").isNotNull()), own, cid(F.col("next")), "NEXT_CHUNK"))
        .unionByName(edge(entities, F.col("chunk"), F.col("id"), "CONTAINS_ENTITY"))
    )
    return nodes, edges


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: str


@dataclass(frozen=True)
class Destination:
    destination_id: str
    enabled: bool = True
    filters: Sequence[Filter] = field(default_factory=tuple)


def _runs(pattern: str) -> bool:
    """Whether the engine that will run the pattern accepts it."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def filter_passes(f: Filter, fields: Mapping[str, Column]) -> Column:
    """Compare as strings, NULL as empty; an invalid regular expression never passes."""
    c = F.coalesce(fields[f.field].cast("string"), F.lit("")) if f.field in fields else F.lit("")
    v = F.lit(f.value)
    if f.operator == "regex":
        return c.rlike(f.value) if _runs(f.value) else F.lit(False)
    return {
        "equals": c == v, "not_equals": c != v, "contains": F.contains(c, v),
        "starts_with": F.startswith(c, v), "ends_with": F.endswith(c, v),
    }.get(f.operator, F.lit(True))


def route(records: DataFrame, destinations: Sequence[Destination], fields: Mapping[str, Column]) -> DataFrame:
    """One row per record and destination with ``status`` and the first failing filter as reason.

    Rules are configuration, so they become expressions of one scan; nothing is joined.
    """
    def verdict(d: Destination) -> Column:
        reason = F.coalesce(*[F.when(~filter_passes(f, fields), F.lit(f"{f.field} {f.operator} {f.value}")) for f in d.filters], F.lit(None).cast("string"))
        status = F.lit("skipped") if not d.enabled else F.when(reason.isNotNull(), "filtered").otherwise("routed")
        return F.struct(F.lit(d.destination_id).alias("destination_id"), status.alias("status"),
                        (reason if d.enabled else F.lit("disabled")).alias("reason"))

    return records.withColumn("_r", F.explode(F.array(*[verdict(d) for d in destinations]))).select("*", "_r.*").drop("_r")


def write_routed(routed: DataFrame, root: str, columns: Sequence[str]) -> None:
    """All destinations in one write, one folder per destination."""
    routed.where(F.col("status") == "routed").select("destination_id", *columns).write.partitionBy("destination_id").parquet(root)


def routing_outcome(results: DataFrame, key: str) -> DataFrame:
    """success, partial_success or failed per record, with counts and the first reason.

    ``results(key, destination_id, status)`` where status is success, failed, filtered or skipped.
    """
    counted = results.groupBy(key).agg(
        F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status").isin("filtered", "skipped")).alias("n_skipped"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("destination_id"))).alias("first_reason"))
    overall = F.when((F.col("n_failed") > 0) & (F.col("n_success") > 0), "partial_success").when(F.col("n_failed") > 0, "failed").when(
        F.col("n_success") > 0, "success").otherwise("skipped")
    return counted.withColumn("overall", overall)


def sweep(rows: DataFrame, expired: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that go; a NULL expiry stays."""
    gone = F.coalesce(expired, F.lit(False))
    return rows.where(~gone), rows.where(gone)


def missing_embeddings(chunks: DataFrame, embedded: DataFrame, limit: int, job: str = "doc_id") -> DataFrame:
    """Chunks without an embedding, in chunk order, at most ``limit`` per job."""
    order = Window.partitionBy(job).orderBy("chunk_index")
    return chunks.join(embedded.select("chunk_id"), "chunk_id", "left_anti").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def copy_new(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows whose key the target does not have yet."""
    return source.join(target.select(key), key, "left_anti")


def reconcile(source: DataFrame, target: DataFrame, key: str, digest: Column) -> DataFrame:
    """Every key with its status: missing, extra, changed or equal."""
    s = source.select(key, digest.alias("s"))
    t = target.select(key, digest.alias("t"))
    status = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s") != F.col("t"), "changed").otherwise("equal")
    return s.join(t, key, "full_outer").select(key, status.alias("status"))
