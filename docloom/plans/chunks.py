"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import tables
from docloom.functions import ordered
from docloom.operators import chunking
from docloom.plans import fragments as sq
from docloom.plans.registry import query
from docloom.sources import markup


def page_documents(spark, sf_dir):
    """Pages as Markdown documents, so headers and paragraphs exist."""
    pages = tables.load(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("doc_id"), markup.html_to_markdown(F.col("html")).alias("text"))


PAGE_MARKDOWN = r"""
page_docs AS (
  SELECT page_id AS doc_id,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(html,
      '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'),
      '(?s)<!--.*?-->', '', 'g'), '<title>([^<]*)</title>', chr(10) || '# \1' || chr(10), 'g'),
      '<h1>', chr(10) || '## ', 'g'), '</h1>', chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'),
      '(?i)<p>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g') AS text
  FROM pages
)"""


@query(
    "chk1_fixed_windows",
    sq.with_(sq.CHUNKS) + "SELECT doc_id, chunk_index, start_char, end_char, content_hash FROM chunks",
)
def chk1(spark, sf_dir):
    return chunking.fixed_windows(tables.load(spark, sf_dir, "documents")).select(
        "doc_id", "chunk_index", F.col("start_char").cast("long").alias("start_char"),
        F.col("end_char").cast("long").alias("end_char"), "content_hash",
    )


@query("chk2_pack_paragraphs")
def chk2(spark, sf_dir):
    return chunking.pack_paragraphs(page_documents(spark, sf_dir)).select(
        "doc_id", "chunk_index", "char_count", "content_hash"
    )


@query(
    "chk3_token_windows",
    r"""
WITH toks AS (
  SELECT doc_id, length(text) AS n_chars, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS tok
  FROM documents),
win AS (
  SELECT *, unnest(range(0, greatest(len(tok) - 50, 1), 462)) AS s FROM toks WHERE len(tok) > 0)
SELECT doc_id, CAST(s / 462 AS INTEGER) AS chunk_index, CAST(least(s + 512, len(tok)) - s AS INTEGER) AS token_count,
       CAST(least(s * 4, n_chars) AS INTEGER) AS char_start,
       CAST(least(least(s + 512, len(tok)) * 4, n_chars) AS INTEGER) AS char_end,
       md5(array_to_string(tok[s + 1:s + 512], ' ')) AS content_md5
FROM win""",
)
def chk3(spark, sf_dir):
    out = chunking.token_windows(tables.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk_index", "token_count", "char_start", "char_end", F.md5("content").alias("content_md5"))


@query("chk4_semantic_sentences")
def chk4(spark, sf_dir):
    out = chunking.semantic_sentences(tables.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk_index", "sentence_count", "token_count", F.md5("content").alias("content_md5"))


@query(
    "chk5_sections",
    sq.with_(PAGE_MARKDOWN) + r""",
ln AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM page_docs)),
marked AS (
  SELECT *, length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) AS level, regexp_extract(line, '^(#{1,6})\s+(.+)$', 2) AS header
  FROM ln),
numbered AS (
  SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM marked),
secs AS (
  SELECT doc_id, sec, max(level) AS level, max(header) AS header,
         regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS content
  FROM numbered WHERE sec > 0 GROUP BY doc_id, sec),
up AS (
  SELECT c.doc_id, c.sec, p.sec AS psec, p.level AS plevel, p.header AS pheader
  FROM secs c JOIN secs p ON c.doc_id = p.doc_id AND p.sec < c.sec AND p.level < c.level
  WHERE NOT EXISTS (SELECT 1 FROM secs m WHERE m.doc_id = c.doc_id AND m.sec > p.sec AND m.sec < c.sec AND m.level <= p.level)),
path AS (
  SELECT doc_id, sec, string_agg(pheader, ' > ' ORDER BY psec) AS above, arg_max(pheader, psec) AS parent FROM up GROUP BY 1, 2)
SELECT s.doc_id, CAST(s.sec - 1 AS INTEGER) AS section_no, s.header, CAST(s.level AS INTEGER) AS level, p.parent,
       CASE WHEN p.above IS NULL THEN s.header ELSE p.above || ' > ' || s.header END AS path,
       CAST(length(s.content) // 4 AS INTEGER) AS token_count, md5(s.content) AS content_md5
FROM secs s LEFT JOIN path p ON s.doc_id = p.doc_id AND s.sec = p.sec""",
)
def chk5_sections(spark, sf_dir):
    secs = chunking.sections(page_documents(spark, sf_dir))
    return secs.select(
        "doc_id", "section_no", "header", "level", "parent", F.array_join("path", " > ").alias("path"),
        F.floor(F.length("content") / F.lit(4)).cast("int").alias("token_count"), F.md5("content").alias("content_md5"),
    )


@query("chk5_hierarchical")
def chk5(spark, sf_dir):
    docs = page_documents(spark, sf_dir).unionByName(
        tables.load(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text"))
    return chunking.hierarchical(docs).withColumn("content_md5", F.md5("content")).drop("content")


@query(
    "chk6_strategy",
    sq.with_(PAGE_MARKDOWN) + r""",
d AS (SELECT 'page' AS kind, text FROM page_docs UNION ALL SELECT lang, text FROM documents),
s AS (SELECT kind, length(text) AS n,
  CASE WHEN regexp_matches(text, '(?m)^#{1,6}\s+.+$') THEN 'hierarchical'
  WHEN """
    + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in chunking.TECHNICAL_WORDS)
    + """ > 3 THEN 'semantic' ELSE 'fixed' END AS strategy FROM d)
SELECT kind, strategy, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_chars FROM s GROUP BY 1, 2""",
)
def chk6(spark, sf_dir):
    pages = page_documents(spark, sf_dir).select(F.lit("page").alias("kind"), "text")
    docs = tables.load(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), "text")
    chosen = chunking.choose_strategy(pages.unionByName(docs))
    return chosen.groupBy("kind", "strategy").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text").cast("long")).alias("n_chars"))


@query("chk6_chunk_by_strategy")
def chk6_chunks(spark, sf_dir):
    docs = page_documents(spark, sf_dir).unionByName(
        tables.load(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text"))
    return chunking.chunk_by_strategy(docs).withColumn("content_md5", F.md5("content")).drop("content")


@query(
    "chk7_chunk_report",
    sq.with_(sq.CHUNKS) + r"""
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n_chunks,
       CAST(sum(length(content) // 4) AS BIGINT) AS total_tokens, CAST(min(length(content)) AS INTEGER) AS min_chars,
       CAST(max(length(content)) AS INTEGER) AS max_chars, quantile_cont(length(content), 0.5) AS median_chars
FROM chunks GROUP BY ROLLUP (lang, source)""",
)
def chk7(spark, sf_dir):
    report = chunking.chunk_report(tables.chunks(spark, sf_dir), ["lang", "source"])
    return report.withColumn("lang", F.coalesce("lang", F.lit("all"))).withColumn("source", F.coalesce("source", F.lit("all")))


@query(
    "chk8_row_blocks",
    """
WITH r AS (
  SELECT event_type, event_id, length(props) AS n, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS block
  FROM events)
SELECT event_type, CAST(block AS BIGINT) AS block, count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id,
       CAST(sum(n) AS BIGINT) AS n_chars
FROM r GROUP BY 1, 2""",
)
def chk8(spark, sf_dir):
    events = tables.load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return chunking.row_blocks(events, ["event_type"], "day", ["ts", "event_id"], 100).groupBy("event_type", "block").agg(
        F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
        F.sum(F.length("props").cast("long")).alias("n_chars"))


@query("chk8_size_blocks")
def chk8_sizes(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("items"))
    blocks = chunking.size_blocks(docs, "items", 1000)
    return blocks.select("doc_id", "block", F.size("content").alias("n_items"), F.md5(F.array_join("content", "\n")).alias("content_md5"))
