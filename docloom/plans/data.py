"""Source and sink queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from docloom import tables
from docloom.operators import sinks
from docloom.plans import fragments as sq
from docloom.plans.registry import query
from docloom.session import shared_dir
from docloom.sources import files, markup, structured


def scratch(spark, name):
    return os.path.join(shared_dir(spark), "docloom", f"{name}-{uuid.uuid4().hex}")


@query(
    "src1_file_listing",
    """
SELECT source AS folder, 'text/plain' AS mime_type, CAST(sum(strlen(replace(text, chr(10), ' ')) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY 1""",
)
def src1(spark, sf_dir):
    path = scratch(spark, "listing")
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    tables.load(spark, sf_dir, "documents").select("source", line.alias("value")).write.partitionBy("source").text(path)
    listed = files.list_files(spark, path, pattern="*.txt")
    return listed.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder"), "mime_type").agg(F.sum("size").alias("n_bytes"))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "empty"]


@query(
    "src3_delimited_types",
    """
SELECT * FROM (VALUES ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'string'), ('o_totalprice', 'float'),
  ('o_orderdate', 'date'), ('o_orderpriority', 'string'), ('empty', 'unknown')) t("column", type)
JOIN (SELECT count(*) AS n FROM orders) ON true""".replace("SELECT *", "SELECT \"column\", type, CASE WHEN type = 'unknown' THEN 0 ELSE n END AS n_values", 1),
)
def src3(spark, sf_dir):
    path = scratch(spark, "orders") + ".csv"
    orders = tables.load(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("empty", F.lit(""))
    orders.select(*ORDER_COLUMNS).write.csv(path, header=True, sep=";", emptyValue="")
    return structured.column_types(structured.read_delimited(spark, path))


@query(
    "src4_json_lines",
    """
WITH l AS (SELECT event_type, CASE WHEN event_type = 'error' AND value > 20 THEN left(props, -1) ELSE props END AS value FROM events),
c AS (SELECT event_type, count(*) AS n_lines, count(*) FILTER (json_valid(value)) AS n_records, count(*) FILTER (NOT json_valid(value)) AS n_errors FROM l GROUP BY 1)
SELECT *, round(CASE WHEN n_errors = 0 THEN 0.95 ELSE greatest(0.5, 1 - n_errors / n_lines) END::DOUBLE, 6) AS confidence FROM c""",
)
def src4(spark, sf_dir):
    path = scratch(spark, "events")
    broken = F.when((F.col("event_type") == "error") & (F.col("value") > 20), F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    tables.load(spark, sf_dir, "events").select("event_type", broken.alias("value")).write.partitionBy("event_type").text(path)
    out = structured.json_lines(spark.read.text(path), "event_type")
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "src5_json_key_types",
    """
SELECT 'k' AS key, 'integer' AS types, count(*) AS n_values FROM events
UNION ALL SELECT 'q', 'float', count(*) FROM lineitem
UNION ALL SELECT 'f', 'string', count(*) FROM lineitem
UNION ALL SELECT 'n', CASE WHEN count(*) FILTER (l_linenumber > 3) = 0 THEN 'integer' WHEN count(*) FILTER (l_linenumber <= 3) = 0 THEN 'null' ELSE 'integer|null' END, count(*) FROM lineitem
UNION ALL SELECT 'b', 'boolean', count(*) FROM lineitem
UNION ALL SELECT 'a', 'array', count(*) FROM lineitem
UNION ALL SELECT 'o', 'object', count(*) FROM lineitem""",
)
def src5(spark, sf_dir):
    props = tables.load(spark, sf_dir, "events").select(F.col("props").alias("json"))
    line = F.concat(
        F.lit('{"q": '), F.col("l_quantity").cast("string"), F.lit(', "f": "'), F.col("l_returnflag"), F.lit('", "n": '),
        F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber").cast("string")).otherwise("null"),
        F.lit(', "b": '), (F.col("l_tax") > 0.04).cast("string"), F.lit(', "a": [1, 2], "o": {"x": 1}}'))
    lines = tables.load(spark, sf_dir, "lineitem").select(line.alias("json"))
    return structured.key_types(props.unionByName(lines))


@query("src6_xml_rows", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def src6(spark, sf_dir):
    path = scratch(spark, "customers")
    rows = tables.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("name"), F.col("c_mktsegment").alias("segment"))
    rows.write.format("xml").option("rootTag", "customers").option("rowTag", "customer").save(path)
    return markup.read_xml(spark, path, "customer", "id long, name string, segment string")


@query(
    "src6_xpath",
    "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus AS found FROM orders",
)
def src6_xpath(spark, sf_dir):
    xml = F.concat(F.lit("<order><who><key> "), F.col("o_custkey").cast("string"), F.lit(" </key></who><status><key>\n"), F.col("o_orderstatus"), F.lit("</key></status><key/></order>"))
    orders = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), xml.alias("xml"))
    return orders.select("id", F.array_join(markup.xpath_values(F.col("xml"), "//key/text()"), "|").alias("found"))


HTML_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'),
  '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<(br|p)(\s[^>]*)?/?>', ' ', 'g'), '<[^>]+>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("src7_html_text", f"SELECT page_id, length({HTML_TEXT}) AS n_chars, md5({HTML_TEXT}) AS text_md5 FROM pages".replace("length(", "CAST(length(", 1).replace(" AS n_chars", " AS INTEGER) AS n_chars", 1))
def src7(spark, sf_dir):
    pages = tables.load(spark, sf_dir, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


RESULTS = f"""
r AS (SELECT doc_id AS result_id, sha256(text) AS h, CASE WHEN toxic = 1 THEN NULL ELSE TIMESTAMP '{tables.FIXED_CLOCK}' + to_hours(CAST(1000 - n_chars AS BIGINT)) END AS expires_at
  FROM documents JOIN labels USING (doc_id)),
live AS (SELECT h, max(result_id) AS result_id FROM r WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{tables.FIXED_CLOCK}' GROUP BY h),
m AS (SELECT doc_id AS file_id, lang, result_id FROM documents LEFT JOIN live ON sha256(text) = h)"""


def matched_files(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents")
    clock = F.to_timestamp(F.lit(tables.FIXED_CLOCK))
    results = docs.join(tables.load(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("result_id"), F.sha2("text", 256).alias("content_hash"),
        F.when(F.col("toxic") != 1, F.timestamp_seconds(F.unix_timestamp(clock) + (1000 - F.col("n_chars")) * 3600)).alias("expires_at"))
    return files.known_results(docs.select(F.col("doc_id").alias("file_id"), "lang", F.col("text").alias("content")), results, clock)


@query("src8_fingerprints", "WITH" + RESULTS + " SELECT lang, count(*) AS n_files, count(result_id) AS n_hits FROM m GROUP BY 1")
def src8(spark, sf_dir):
    return matched_files(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_files"), F.count("result_id").alias("n_hits"))


@query("src8_access_counts", "WITH" + RESULTS + " SELECT result_id, count(*) AS n_accesses FROM m WHERE result_id IS NOT NULL GROUP BY 1")
def src8_counts(spark, sf_dir):
    return files.access_counts(matched_files(spark, sf_dir))


_EXT = ["docx", "xls", "png", "GIF", "csv", "jsonl", "xml", "zip", "pdf", "tar.gz", "tiff"]
_EXT_SQL = "[" + ", ".join(f"'{e}'" for e in _EXT) + "]"


@query(
    "src9_type_inventory",
    f"""
WITH f AS (SELECT 'in/' || source || '/' || doc_id || '.' || {_EXT_SQL}[1 + n_chars % {len(_EXT)}] AS path, n_chars FROM documents),
t(ext, content_type, parser, confidence) AS (VALUES {", ".join(str(r) for r in files.FILE_TYPES)}),
e AS (SELECT lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext, n_chars FROM f)
SELECT coalesce(content_type, 'unknown') AS content_type, coalesce(parser, 'layout') AS parser, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_bytes,
  round(avg(coalesce(confidence, 0.5)::DOUBLE), 6) AS confidence FROM e LEFT JOIN t USING (ext) GROUP BY 1, 2""",
)
def src9(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("n_chars") % len(_EXT)).cast("int") + 1)
    listing = tables.load(spark, sf_dir, "documents").select(
        F.concat(F.lit("in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.col("n_chars").alias("size"))
    return files.type_inventory(listing)


@query(
    "snk1_chunk_upsert",
    sq.with_(sq.CHUNKS) + """,
old AS (SELECT doc_id, chunk_index, chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels)),
new AS (SELECT doc_id, chunk_index, lang FROM chunks WHERE lang IN ('en', 'fr'))
SELECT CASE WHEN n.doc_id IS NULL THEN 'old' ELSE 'new' END AS content, CASE WHEN o.doc_id IS NULL THEN 'new' ELSE 'old' END AS row_origin, count(*) AS n,
  CAST(sum(coalesce(o.chunk_index, n.chunk_index)) AS BIGINT) AS index_sum
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id AND o.chunk_index = n.chunk_index GROUP BY 1, 2""",
)
def snk1(spark, sf_dir):
    """The table after two upserts, the second one sent twice."""
    chunks = tables.chunks(spark, sf_dir)
    labels = tables.load(spark, sf_dir, "labels").select("doc_id")
    rows = lambda df, word: df.select(F.col("doc_id").alias("job_id"), "chunk_index", F.lit(word).alias("content"), F.lit(word).alias("row_origin"))
    old, new = rows(chunks.join(labels, "doc_id", "left_semi"), "old"), rows(chunks.where(F.col("lang").isin("en", "fr")), "new")
    path = scratch(spark, "chunk-table")
    for incoming in (old, new, new.unionByName(new)):
        sinks.upsert_table(spark, path, incoming, ["job_id", "chunk_index"], ["content"], buckets=8 if incoming is old else None)
    return spark.read.parquet(path).groupBy("content", "row_origin").agg(F.count("*").alias("n"), F.sum("chunk_index").alias("index_sum"))


@query(
    "snk2_embedding_upsert",
    """
WITH old AS (SELECT vec_id, 'small' AS model FROM embeddings WHERE label < 7), new AS (
  SELECT vec_id, 'small' AS model FROM embeddings WHERE label >= 4 UNION ALL SELECT vec_id, 'large' FROM embeddings WHERE label < 2)
SELECT coalesce(o.model, n.model) AS model, CASE WHEN o.vec_id IS NULL THEN 'inserted' WHEN n.vec_id IS NULL THEN 'kept' ELSE 'updated' END AS action, count(*) AS n
FROM old o FULL JOIN new n ON o.vec_id = n.vec_id AND o.model = n.model GROUP BY 1, 2""",
)
def snk2(spark, sf_dir):
    vectors = tables.load(spark, sf_dir, "embeddings")
    row = lambda cond, model: vectors.where(cond).select(F.col("vec_id").alias("chunk_id"), F.lit(model).alias("model_name"), "embedding")
    old = row(F.col("label") < 7, "small")
    new = row(F.col("label") >= 4, "small").unionByName(row(F.col("label") < 2, "large"))
    merged = sinks.merge_rows(old, new, ["chunk_id", "model_name"], ["embedding"])
    return merged.groupBy(F.col("model_name").alias("model"), "action").agg(F.count("*").alias("n"))


@query(
    "snk3_bulk_export",
    sq.with_(sq.CHUNKS) + "SELECT format, count(*) AS n_rows FROM chunks, (SELECT unnest(['csv', 'json', 'parquet']) AS format) GROUP BY 1",
)
def snk3(spark, sf_dir):
    chunks = tables.chunks(spark, sf_dir).select("chunk_id", "content_hash", "content", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    counts = None
    for fmt in ("json", "csv", "parquet"):
        path = scratch(spark, fmt)
        sinks.export(chunks, path, fmt, include_text=fmt != "csv")
        back = {"json": spark.read.json, "csv": lambda p: spark.read.csv(p, header=True), "parquet": spark.read.parquet}[fmt](path)
        one = back.agg(F.lit(fmt).alias("format"), F.count("chunk_id").alias("n_rows"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query(
    "snk4_vector_records",
    sq.with_(sq.CHUNKS) + """
SELECT doc_id || '_chunk_' || chunk_index AS id, CAST(coalesce(len(e.embedding), 0) AS INTEGER) AS n_values,
  CAST(length(content) AS INTEGER) AS n_content, 'chunk_index,content,job_id,lang,n' AS keys FROM chunks LEFT JOIN embeddings e ON e.vec_id = doc_id""",
)
def snk4(spark, sf_dir):
    rows = tables.chunk_vectors(spark, sf_dir).select(
        F.col("doc_id").alias("job_id"), "chunk_index", "content", F.col("vec").alias("embedding"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("n"), F.col("chunk_index").cast("string"), F.lit("tags"), F.lit('["a"]'), F.lit("nested"), F.lit('{"a": 1}')).alias("metadata"))
    out = sinks.vector_records(rows, max_content=1000)
    return out.select(
        "id", F.when(F.col("values").isNull(), 0).otherwise(F.size("values")).alias("n_values"), F.length(F.col("metadata")["content"]).alias("n_content"),
        F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"))


PROPERTY = sq.with_(sq.CHUNKS) + """,
n AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'Document' AS label FROM documents UNION ALL SELECT doc_id || '_chunk_' || chunk_index, 'Chunk' FROM chunks
  UNION ALL SELECT doc_id || '_chunk_' || chunk_index || '_ent_' || k, 'Entity' FROM chunks, (SELECT unnest(['title', 'author']) AS k) WHERE chunk_index < 3),
e AS (SELECT CAST(doc_id AS VARCHAR) AS src, doc_id || '_chunk_' || chunk_index AS dst, 'HAS_CHUNK' AS type FROM chunks
  UNION ALL SELECT doc_id || '_chunk_' || chunk_index, doc_id || '_chunk_' || (chunk_index + 1), 'NEXT_CHUNK' FROM chunks c
    WHERE EXISTS (SELECT 1 FROM chunks x WHERE x.doc_id = c.doc_id AND x.chunk_index = c.chunk_index + 1)
  UNION ALL SELECT doc_id || '_chunk_' || chunk_index, doc_id || '_chunk_' || chunk_index || '_ent_' || k, 'CONTAINS_ENTITY' FROM chunks, (SELECT unnest(['title', 'author']) AS k) WHERE chunk_index < 3)"""


def exported_graph(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("author"))
    return sinks.property_graph(tables.chunks(spark, sf_dir).select("doc_id", "chunk_index", "content"), docs, max_content=10_000, max_name=100, entity_chunks=3)


@query("snk5_graph_nodes", PROPERTY + " SELECT label, count(*) AS n, count(DISTINCT id) AS n_ids FROM n GROUP BY 1")
def snk5_nodes(spark, sf_dir):
    return exported_graph(spark, sf_dir)[0].groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("snk5_graph_edges", PROPERTY + " SELECT src, dst, type FROM e")
def snk5_edges(spark, sf_dir):
    return exported_graph(spark, sf_dir)[1]


DESTINATIONS = [
    sinks.Destination("archive", True, (sinks.Filter("lang", "not_equals", "de"), sinks.Filter("source", "starts_with", "src1"))),
    sinks.Destination("search", True, (sinks.Filter("lang", "equals", "en"), sinks.Filter("n_chars", "regex", "^[1-4]"), sinks.Filter("source", "ends_with", "5"))),
    sinks.Destination("metrics", True, (sinks.Filter("source", "contains", "c1"), sinks.Filter("missing", "equals", ""))),
    sinks.Destination("broken", True, (sinks.Filter("lang", "regex", "("),)),
    sinks.Destination("off", False, ()),
]
ROUTED = """
rt AS (
  SELECT doc_id, lang, n_chars, 'archive' AS destination_id, CASE WHEN NOT lang <> 'de' THEN 'lang not_equals de' WHEN NOT starts_with(source, 'src1') THEN 'source starts_with src1' END AS reason FROM documents
  UNION ALL SELECT doc_id, lang, n_chars, 'search', CASE WHEN NOT lang = 'en' THEN 'lang equals en' WHEN NOT regexp_matches(CAST(n_chars AS VARCHAR), '^[1-4]') THEN 'n_chars regex ^[1-4]'
    WHEN NOT ends_with(source, '5') THEN 'source ends_with 5' END FROM documents
  UNION ALL SELECT doc_id, lang, n_chars, 'metrics', CASE WHEN NOT contains(source, 'c1') THEN 'source contains c1' END FROM documents
  UNION ALL SELECT doc_id, lang, n_chars, 'broken', 'lang regex (' FROM documents
  UNION ALL SELECT doc_id, lang, n_chars, 'off', 'disabled' FROM documents),
rs AS (SELECT *, CASE WHEN destination_id = 'off' THEN 'skipped' WHEN reason IS NOT NULL THEN 'filtered' ELSE 'routed' END AS status FROM rt)"""


def routed(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return sinks.route(docs, DESTINATIONS, {"lang": F.col("lang"), "source": F.col("source"), "n_chars": F.col("n_chars")})


@query("snk6_routing", "WITH" + ROUTED + " SELECT destination_id, status, reason, count(*) AS n FROM rs GROUP BY 1, 2, 3")
def snk6(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("destination_id", "status", "reason").agg(F.count("*").alias("n"))


@query(
    "snk7_routing_outcome",
    "WITH" + ROUTED + """,
d AS (SELECT doc_id, destination_id, reason, CASE WHEN status <> 'routed' THEN status WHEN destination_id = 'archive' AND n_chars > 2000 THEN 'failed' ELSE 'success' END AS status FROM rs),
o AS (SELECT doc_id, count(*) FILTER (status = 'success') AS s, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status IN ('filtered', 'skipped')) AS k,
  arg_min(reason, destination_id) FILTER (reason IS NOT NULL) AS first_reason FROM d GROUP BY 1)
SELECT CASE WHEN f > 0 AND s > 0 THEN 'partial_success' WHEN f > 0 THEN 'failed' WHEN s > 0 THEN 'success' ELSE 'skipped' END AS overall, first_reason,
  count(*) AS n, CAST(sum(s) AS BIGINT) AS n_success, CAST(sum(f) AS BIGINT) AS n_failed, CAST(sum(k) AS BIGINT) AS n_skipped FROM o GROUP BY 1, 2""",
)
def snk7(spark, sf_dir):
    delivered = F.when(F.col("status") != "routed", F.col("status")).when((F.col("destination_id") == "archive") & (F.col("n_chars") > 2000), "failed").otherwise("success")
    outcome = sinks.routing_outcome(routed(spark, sf_dir).withColumn("status", delivered), "doc_id")
    return outcome.groupBy("overall", "first_reason").agg(
        F.count("*").alias("n"), F.sum("n_success").alias("n_success"), F.sum("n_failed").alias("n_failed"), F.sum("n_skipped").alias("n_skipped"))


@query(
    "snk8_expiry_sweep",
    f"""
WITH j AS (SELECT 'job_results' AS kind, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + to_days(7300) END < TIMESTAMP '{tables.FIXED_CLOCK}' AS gone FROM orders),
a AS (SELECT 'audit_events', ts < TIMESTAMP '{tables.FIXED_CLOCK}' - to_days(14) FROM events),
s(kind, gone) AS (SELECT * FROM j UNION ALL SELECT * FROM a)
SELECT kind, count(*) FILTER (NOT coalesce(gone, false)) AS n_kept, count(*) FILTER (coalesce(gone, false)) AS n_removed FROM s GROUP BY 1""",
)
def snk8(spark, sf_dir):
    clock = F.to_timestamp(F.lit(tables.FIXED_CLOCK))
    jobs = tables.load(spark, sf_dir, "orders").select(
        F.lit("job_results").alias("kind"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval(F.lit(7300))).alias("expires_at"))
    audit = tables.load(spark, sf_dir, "events").select(F.lit("audit_events").alias("kind"), (F.col("ts") + F.make_dt_interval(F.lit(14))).alias("expires_at"))
    kept, gone = sinks.sweep(jobs.unionByName(audit), F.col("expires_at") < clock)
    both = kept.select("kind", F.lit(0).alias("gone")).unionByName(gone.select("kind", F.lit(1).alias("gone")))
    return both.groupBy("kind").agg(F.count_if(F.col("gone") == 0).alias("n_kept"), F.count_if(F.col("gone") == 1).alias("n_removed"))


@query(
    "snk9_missing_embeddings",
    sq.with_(sq.CHUNKS) + """
SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM chunks
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) QUALIFY n <= 5""",
)
def snk9(spark, sf_dir):
    chunks = tables.chunk_vectors(spark, sf_dir)
    have = chunks.where(F.col("vec").isNotNull()).select("chunk_id")
    return sinks.missing_embeddings(tables.chunks(spark, sf_dir), have, 5).select("doc_id", "chunk_index", F.col("n").cast("long").alias("n"))


TARGET = """
tg AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN d.text || '!' ELSE d.text END AS text FROM documents d JOIN labels l USING (doc_id)
       UNION ALL SELECT 1000000000 + item_id, text FROM benchmark)"""


def copied(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = tables.load(spark, sf_dir, "labels")
    have = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    extra = tables.load(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), "text")
    return docs, have.unionByName(extra)


@query("snk10_reconcile", "WITH" + TARGET + """
SELECT CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'extra' WHEN s.text <> t.text THEN 'changed' ELSE 'equal' END AS status, count(*) AS n
FROM documents s FULL JOIN tg t ON s.doc_id = t.doc_id GROUP BY 1""")
def snk10(spark, sf_dir):
    source, target = copied(spark, sf_dir)
    return sinks.reconcile(source, target, "doc_id", F.sha2("text", 256)).groupBy("status").agg(F.count("*").alias("n"))


@query("snk10_incremental_copy", "WITH" + TARGET + " SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tg)")
def snk10_copy(spark, sf_dir):
    source, target = copied(spark, sf_dir)
    return sinks.copy_new(source, target, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))
