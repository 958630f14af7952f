"""Fusion, filtering, context and cache queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import tables
from docloom.session import cut_lineage
from docloom.operators import context as cx
from docloom.operators import fusion as fu
from docloom.operators import vector_search as vs
from docloom.plans import fragments as sq
from docloom.plans.chunks import PAGE_MARKDOWN, page_documents
from docloom.plans.registry import query
from docloom.plans.search import FLOOR, LEG, text_leg, vector_leg
from docloom.operators import chunking

LEGS = sq.with_(sq.CHUNKS, sq.QUERY_TERMS, sq.QUERY_VECTORS, sq.bm25(LEG), sq.vector_leg(LEG, FLOOR)) + """,
both_legs AS (
  SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id, similarity, rank_score,
         v.rank AS vector_rank, t.rank AS text_rank
  FROM v_leg v FULL JOIN t_leg t ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id)"""


def fused(df):
    return df.select("query_id", "chunk_id", F.round("score", 9).alias("score"),
                     F.col("vector_rank").cast("long").alias("vector_rank"), F.col("text_rank").cast("long").alias("text_rank"),
                     F.col("rank").cast("long").alias("rank"))


FUSED = """SELECT query_id, chunk_id, round(score, 9) AS score, vector_rank, text_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10"""


@query(
    "hyb1_weighted_sum",
    LEGS + """,
w AS (SELECT query_id, CASE WHEN n >= 60 THEN 0.9 WHEN n >= 30 THEN 0.7 ELSE 0.3 END AS wv,
             CASE WHEN n >= 60 THEN 0.1 WHEN n >= 30 THEN 0.3 ELSE 0.7 END AS wt
      FROM (SELECT query_id, count(*) AS n FROM query_terms GROUP BY 1)),
best AS (SELECT query_id, max(rank_score) AS best FROM t_leg GROUP BY 1),
f AS (SELECT b.query_id, chunk_id, vector_rank, text_rank,
  round(coalesce(wv, 0.7)::DOUBLE * coalesce(similarity, 0) + coalesce(wt, 0.3)::DOUBLE * coalesce(rank_score / best, 0), 9) AS score
  FROM both_legs b LEFT JOIN w USING (query_id) LEFT JOIN best USING (query_id))
""" + FUSED,
)
def hyb1(spark, sf_dir):
    presets = spark.createDataFrame([(n, *w) for n, w in fu.WEIGHT_PRESETS.items()], "preset string, wv double, wt double")
    sizes = tables.query_terms(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n"))
    preset = F.when(F.col("n") >= 60, "semantic_focus").when(F.col("n") >= 30, "balanced").otherwise("lexical_focus")
    weights = sizes.withColumn("preset", preset).join(F.broadcast(presets), "preset").select("query_id", "wv", "wt")
    return fused(fu.weighted_sum(vector_leg(spark, sf_dir), text_leg(spark, sf_dir), weights, 10))


@query(
    "hyb2_rrf",
    LEGS + """,
f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + text_rank), 0) AS score FROM both_legs)
""" + FUSED,
)
def hyb2(spark, sf_dir):
    return fused(fu.rrf(vector_leg(spark, sf_dir), text_leg(spark, sf_dir), 10))


@query(
    "hyb3_weighted_rrf",
    LEGS + """,
f AS (SELECT *, coalesce(0.7::DOUBLE / (60 + vector_rank), 0) + coalesce(0.3::DOUBLE / (60 + text_rank), 0) AS score FROM both_legs)
""" + FUSED,
)
def hyb3(spark, sf_dir):
    return fused(fu.rrf(vector_leg(spark, sf_dir), text_leg(spark, sf_dir), 10, wv=0.7, wt=0.3))


@query(
    "hyb4_fallback",
    sq.with_(sq.CHUNKS, sq.QUERY_TERMS, sq.QUERY_VECTORS, sq.bm25(LEG), sq.vector_leg(LEG, 0.99999)) + """,
tl AS (SELECT query_id, 'text' AS leg FROM t_leg WHERE rank_score >= 0.98),
legs AS (SELECT query_id, 'vector' AS leg FROM v_leg UNION ALL SELECT * FROM tl),
n AS (SELECT query_id, count(*) FILTER (leg = 'vector') AS nv, count(*) FILTER (leg = 'text') AS nt FROM legs GROUP BY 1),
m(mode) AS (VALUES ('auto'), ('vector'), ('text'), ('strict')),
k AS (SELECT mode, l.query_id, leg FROM legs l JOIN n USING (query_id), m
      WHERE NOT ((nv = 0) <> (nt = 0)) OR mode IN ('auto', 'strict') OR leg = mode)
SELECT mode, query_id, count(*) FILTER (leg = 'vector') AS n_vector, count(*) FILTER (leg = 'text') AS n_text FROM k GROUP BY 1, 2""",
)
def hyb4(spark, sf_dir):
    v = cut_lineage(vector_leg(spark, sf_dir, floor=0.99999), "leg")
    t = cut_lineage(text_leg(spark, sf_dir).where(F.col("rank_score") >= 0.98), "leg")
    counts = None
    for mode in ("auto", "vector", "text", "strict"):
        one = fu.with_fallback(v, t, mode).groupBy("mode", "query_id").agg(
            F.count_if(F.col("leg") == "vector").alias("n_vector"), F.count_if(F.col("leg") == "text").alias("n_text"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query(
    "hyb5_metadata_filters",
    sq.with_(sq.CHUNKS, sq.QUERY_VECTORS) + """,
c AS (SELECT * FROM chunks WHERE source IN ('src1', 'src2', 'src3', 'src5', 'src8') AND lang <> 'de' AND chunk_index >= 0 AND chunk_index < 4
      AND contains(content, 'e')),
s AS (SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(q.query_vec, CAST(e.embedding AS DOUBLE[])), 7) AS sim
      FROM c JOIN embeddings e ON c.doc_id = e.vec_id CROSS JOIN query_vectors q)
SELECT query_id, chunk_id, greatest(0, least(1, sim)) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s WHERE sim >= 0.1 QUALIFY rank <= 10""",
)
def hyb5(spark, sf_dir):
    wanted = fu.conditions({
        "source_type": {"in": ["src1", "src2", "src3", "src5", "src8"]}, "language": {"!=": "de"},
        "chunk_index": {">=": 0, "<": 4}, "content": {"contains": "e"},
    })
    fields = {"source_type": F.col("source"), "language": F.col("lang"), "chunk_index": F.col("chunk_index"), "content": F.col("content")}
    kept = tables.chunk_vectors(spark, sf_dir).where(fu.where_all(wanted, fields))
    hits = vs.top_k(tables.query_vectors(spark, sf_dir), kept.select(F.col("chunk_id").alias("id"), "vec"), 10, 0.1)
    return hits.select("query_id", F.col("id").alias("chunk_id"), "similarity", F.col("rank").cast("long").alias("rank"))


@query(
    "hyb6_dedup",
    sq.with_(sq.CHUNKS, sq.QUERY_TERMS, sq.bm25(LEG)) + """,
r AS (SELECT t.*, c.content_hash FROM t_leg t JOIN chunks c USING (chunk_id)),
g AS (SELECT query_id, content_hash, min(rank) AS slot, max(score) AS score,
      arg_min(chunk_id, (-score, rank)) AS chunk_id FROM r GROUP BY 1, 2)
SELECT query_id, chunk_id, content_hash, score, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS rank FROM g""",
)
def hyb6(spark, sf_dir):
    hashes = tables.chunks(spark, sf_dir).select("chunk_id", "content_hash")
    out = fu.dedup_by_hash(text_leg(spark, sf_dir).join(hashes, "chunk_id"))
    return out.select("query_id", "chunk_id", "content_hash", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "hyb7_entity_filter",
    sq.with_(sq.CHUNKS, sq.QUERY_TERMS, sq.bm25(LEG), sq.MENTIONS) + """
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM t_leg
WHERE chunk_id IN (SELECT chunk_id FROM mentions WHERE entity_type = 'concept' AND contains(lower(entity_text), 'tion'))""",
)
def hyb7(spark, sf_dir):
    m = tables.concept_mentions(spark, sf_dir).where((F.col("entity_type") == "concept") & F.contains(F.lower("entity_text"), F.lit("tion")))
    return fu.keep_matching(text_leg(spark, sf_dir), m).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(
    "hyb8_rerank",
    LEGS + """,
s AS (SELECT v.query_id, v.chunk_id, v.similarity * 8 - 4 AS raw FROM v_leg v),
u AS (SELECT query_id, chunk_id, round(CASE WHEN raw BETWEEN 0 AND 1 THEN raw ELSE 1.0 / (1.0 + exp(-raw)) END, 9) AS rerank_score FROM s)
SELECT query_id, chunk_id, rerank_score,
       row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM u QUALIFY rank <= 5""",
)
def hyb8(spark, sf_dir):
    v = vector_leg(spark, sf_dir)
    scores = v.select("query_id", "chunk_id", (F.col("similarity") * 8 - 4).alias("raw_score"))
    out = fu.rerank(v, scores, 5)
    return out.select("query_id", "chunk_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@query(
    "hyb9_window_context",
    sq.with_(sq.CHUNKS) + """,
w AS (SELECT *, lag(content) OVER x AS p, lead(content) OVER x AS n FROM chunks WINDOW x AS (PARTITION BY doc_id ORDER BY chunk_index)),
s AS (SELECT doc_id, chunk_index, content, left(p, 200) AS p, left(n, 200) AS n FROM w)
SELECT doc_id, chunk_index, md5(concat_ws(' | ', '[Prev: ' || CASE WHEN length(p) > 100 THEN left(p, 100) || '...' ELSE p END || ']', content,
  '[Next: ' || CASE WHEN length(n) > 100 THEN left(n, 100) || '...' ELSE n END || ']')) AS context_md5 FROM s""",
)
def hyb9(spark, sf_dir):
    w = cx.window_context(tables.chunks(spark, sf_dir), 1)
    return w.select("doc_id", "chunk_index", F.md5(cx.format_window(F.col("content"), F.col("previous"), F.col("next"))).alias("context_md5"))


@query(
    "hyb10_parent_context",
    sq.with_(PAGE_MARKDOWN) + r""",
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM page_docs)),
h AS (SELECT doc_id, i, regexp_extract(line, '^(#{1,6})\s+(.+)$', 2) AS header FROM ln WHERE regexp_matches(line, '^(#{1,6})\s+(.+)$')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM h),
hs AS (SELECT doc_id, string_agg(repeat('  ', k) || 'Section: ' || header, chr(10) ORDER BY k) AS sections FROM r GROUP BY 1)
SELECT p.page_id AS doc_id, md5(concat_ws(chr(10), 'Document: ' || url, sections, 'Title: ' || length(html) || ' | Category: ' || regexp_extract(html, 'lang="([a-z]+)"', 1),
  'Content: ' || md5(html))) AS context_md5
FROM pages p LEFT JOIN hs ON p.page_id = hs.doc_id""",
)
def hyb10(spark, sf_dir):
    secs = chunking.sections(page_documents(spark, sf_dir))
    headers = secs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "header"))).alias("hs"))
    pages = tables.load(spark, sf_dir, "pages").withColumnRenamed("page_id", "doc_id").join(headers, "doc_id", "left")
    text = cx.parent_context(
        F.md5("html"), F.col("url"), F.transform("hs", lambda x: x["header"]),
        [("title", F.length("html").cast("string")), ("category", F.regexp_extract("html", 'lang="([a-z]+)"', 1))])
    return pages.select("doc_id", F.md5(text).alias("context_md5"))


@query(
    "hyb11_hierarchy_context",
    sq.with_(sq.CHUNKS) + """
SELECT c.doc_id, c.chunk_index, CASE WHEN l.doc_id IS NOT NULL THEN c.lang || ' > ' || c.source ELSE c.source END AS path,
  md5(concat_ws(chr(10), 'Document: ' || c.source, 'Path: ' || CASE WHEN l.doc_id IS NOT NULL THEN c.lang || ' > ' || c.source ELSE c.source END,
  'Level: ' || CASE WHEN l.doc_id IS NOT NULL THEN 2 ELSE 1 END, 'Content: ' || c.content)) AS context_md5
FROM chunks c LEFT JOIN labels l ON l.doc_id = c.doc_id""",
)
def hyb11(spark, sf_dir):
    chunks = tables.chunks(spark, sf_dir)
    labelled = chunks.join(tables.load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    hierarchy = labelled.select("doc_id", "chunk_index", F.array("lang", "source").alias("path"), F.lit(2).alias("level"))
    own = chunks.select("doc_id", "chunk_index", "content", F.col("source").alias("title"), F.array("source").alias("own_path"))
    return cx.hierarchy_context(own, hierarchy).select("doc_id", "chunk_index", F.col("path_text").alias("path"), F.md5("context").alias("context_md5"))


@query(
    "hyb12_page",
    sq.with_(sq.CHUNKS) + """
SELECT doc_id, chunk_index, content_hash, (SELECT count(*) FROM chunks WHERE source = 'src1') AS total FROM chunks WHERE source = 'src1'
ORDER BY doc_id, chunk_index LIMIT 50 OFFSET 100""",
)
def hyb12(spark, sf_dir):
    rows = tables.chunks(spark, sf_dir).where(F.col("source") == "src1").select("doc_id", "chunk_index", "content_hash")
    return cx.page(rows, ["doc_id", "chunk_index"], 50, 100)


@query(
    "hyb13_duplicate_groups",
    sq.with_(sq.CHUNKS) + "SELECT content_hash, count(*) AS n_copies, min(chunk_id) AS keeper, max(chunk_id) AS latest FROM chunks GROUP BY 1 HAVING count(*) > 1",
)
def hyb13(spark, sf_dir):
    return cx.duplicate_groups(tables.chunks(spark, sf_dir), "content_hash", "chunk_id")


_TRIM = r"regexp_replace(lower(text), '^\s+|\s+$', '', 'g')"
_CASE = lambda i: "CASE " + " ".join(
    "WHEN regexp_matches({t}, '{p}') THEN {v}".format(t=_TRIM, p=row[0].replace("'", "''"), v=(f"'{row[1]}'" if i == 1 else f"{row[2]}::DOUBLE"))
    for row in fu.QUERY_PATTERNS) + " END"
CLASSIFIED = f"""
q AS (SELECT conv_id * 1000 + turn AS query_id, role, text FROM conversations
      UNION ALL SELECT 1000000000 + item_id, 'item', text FROM benchmark),
cl AS (SELECT query_id, role, {_CASE(1)} AS query_type, {_CASE(2)} AS confidence FROM q)"""


def asked(spark, sf_dir):
    turns = tables.load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "role", "text")
    items = tables.load(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000000).alias("query_id"), F.lit("item").alias("role"), "text")
    return turns.unionByName(items)


@query(
    "hyb14_query_types",
    "WITH" + CLASSIFIED + " SELECT role, query_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM cl GROUP BY 1, 2",
)
def hyb14(spark, sf_dir):
    return fu.classify_queries(asked(spark, sf_dir)).groupBy("role", "query_type").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(
    "hyb14_retrieval_plan",
    "WITH" + CLASSIFIED + """,
k AS (SELECT query_id, CASE WHEN role = 'system' THEN 'fast' WHEN role = 'assistant' THEN 'thorough' ELSE 'auto' END AS preset,
      coalesce(query_type, 'vague') AS kind FROM cl)
SELECT query_id, CASE WHEN preset <> 'auto' THEN preset ELSE 'auto_' || kind END AS plan,
  CASE preset WHEN 'fast' THEN false WHEN 'thorough' THEN true ELSE kind NOT IN ('factual', 'comparative') END AS hyde,
  preset <> 'fast' AS reranking, true AS hybrid, true AS query_rewrite FROM k""",
)
def hyb14_plan(spark, sf_dir):
    preset = F.when(F.col("role") == "system", "fast").when(F.col("role") == "assistant", "thorough").otherwise("auto")
    return fu.retrieval_plan(fu.classify_queries(asked(spark, sf_dir)), preset).select(
        "query_id", "plan", "hyde", "reranking", "hybrid", "query_rewrite")


@query(
    "hyb15_quality_gate",
    LEGS + f""",
g AS (SELECT query_id, count(*) AS n_results, avg(similarity) FILTER (rank <= 5) AS mean5, count(*) FILTER (rank <= 5) AS n5,
      min(similarity) FILTER (rank <= 3) AS min3 FROM v_leg GROUP BY 1),
ql AS (SELECT query_id, n_results, round(CASE WHEN n5 >= 3 AND min3 > 0.5 THEN least(1.0, mean5 * 1.1) ELSE mean5 END, 9) AS quality FROM g),
cl AS (SELECT item_id AS query_id, coalesce({_CASE(1)}, 'vague') AS kind FROM benchmark)
SELECT query_id, n_results, quality, quality < 0.7 AS needs_another_pass,
  CASE WHEN quality >= 0.7 THEN 'none' WHEN kind IN ('factual', 'comparative') THEN 'enable_hyde' WHEN n_results < 10 THEN 'increase_k' ELSE 'expand_terms' END AS action
FROM ql JOIN cl USING (query_id)""",
)
def hyb15(spark, sf_dir):
    gated = fu.quality_gate(vector_leg(spark, sf_dir), "similarity")
    items = tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    plan = fu.retrieval_plan(fu.classify_queries(items)).select("query_id", "hyde", "hybrid")
    return fu.corrective_action(gated.join(plan, "query_id")).select(
        "query_id", "n_results", "quality", "needs_another_pass", "action")


CACHE = """
d AS (SELECT d.doc_id, sha256(d.text) AS h, CAST(e.embedding AS DOUBLE[]) AS v, n_chars FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
cache AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM labels) AND 86400 * 30 > n_chars * 3600),
q AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
ex AS (SELECT h, min(doc_id) AS exact_id FROM cache GROUP BY h),
lk AS (SELECT q.*, exact_id FROM q LEFT JOIN ex USING (h)),
nr AS (SELECT l.doc_id, c.doc_id AS near_id, round(list_cosine_similarity(l.v, c.v), 7) AS sim,
       row_number() OVER (PARTITION BY l.doc_id ORDER BY round(list_cosine_similarity(l.v, c.v), 7) DESC, c.doc_id) AS r
       FROM lk l JOIN cache c ON c.v IS NOT NULL WHERE exact_id IS NULL AND l.v IS NOT NULL AND round(list_cosine_similarity(l.v, c.v), 7) >= 0.35),
looked AS (SELECT lk.doc_id AS query_id, n_chars, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN near_id IS NOT NULL THEN 'semantic' ELSE 'miss' END AS layer,
  coalesce(exact_id, near_id) AS cache_id, CASE WHEN exact_id IS NULL THEN sim END AS similarity
  FROM lk LEFT JOIN (SELECT * FROM nr WHERE r = 1) n ON n.doc_id = lk.doc_id)"""


def lookups(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("query_hash"), "n_chars")
    vectors = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    docs = docs.join(vectors, "doc_id", "left")
    labels = tables.load(spark, sf_dir, "labels").select("doc_id")
    clock = F.to_timestamp(F.lit(tables.FIXED_CLOCK))
    cache = docs.join(labels, "doc_id", "left_semi").select(
        F.col("doc_id").alias("cache_id"), "query_hash", "vec",
        F.timestamp_seconds(F.unix_timestamp(clock) - F.col("n_chars") * 3600).alias("created_at"), F.lit(86400 * 30).alias("ttl_seconds"))
    queries = docs.join(labels, "doc_id", "left_anti").select(
        F.col("doc_id").alias("query_id"), "query_hash", F.col("vec").alias("query_vec"), "n_chars")
    return cx.cache_lookup(queries, cache, clock, 0.35), queries


@query("hyb16_cache_lookup", "WITH" + CACHE + " SELECT query_id, layer, cache_id, similarity FROM looked")
def hyb16(spark, sf_dir):
    return lookups(spark, sf_dir)[0]


@query(
    "hyb17_cache_statistics",
    "WITH" + CACHE + """
SELECT coalesce(layer, 'all') AS layer, count(*) AS n, count(*) FILTER (layer <> 'miss') AS hits,
  round(avg(CASE WHEN layer <> 'miss' THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(n_chars / 10.0), 6) AS avg_latency_ms
FROM (SELECT layer, n_chars FROM looked) GROUP BY ROLLUP (layer)""",
)
def hyb17(spark, sf_dir):
    found, queries = lookups(spark, sf_dir)
    timed = found.join(queries.select("query_id", (F.col("n_chars") / 10.0).alias("latency_ms")), "query_id")
    return cx.cache_statistics(timed)
