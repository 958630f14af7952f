"""Vector, embedding and text search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import tables
from docloom.functions import text as tx
from docloom.operators import embeddings as emb
from docloom.operators import postings as ps
from docloom.operators import text_search as ts
from docloom.operators import vector_cells as vc
from docloom.operators import vector_search as vs
from docloom.plans import fragments as sq
from docloom.plans.registry import query

LEG = 20
FLOOR = 0.2


def vector_leg(spark, sf_dir, k: int = LEG, floor: float = FLOOR):
    vectors = tables.chunk_vectors(spark, sf_dir).select(F.col("chunk_id").alias("id"), "vec")
    hits = vs.top_k(tables.query_vectors(spark, sf_dir), vectors, k, floor)
    return hits.withColumnRenamed("id", "chunk_id")


def text_leg(spark, sf_dir, k: int = LEG):
    return ps.ranked(tables.chunk_index(spark, sf_dir), term_queries(spark, sf_dir), k)


def term_queries(spark, sf_dir):
    """Benchmark items as queries of their distinct words but stop words."""
    words = F.array_distinct(tx.words(F.col("text")))
    terms = F.array_except(words, F.array(*[F.lit(w) for w in tx.ENGLISH_STOP_WORDS]))
    return tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))


def all_vectors(spark, sf_dir):
    return tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def hits(df):
    return df.select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


SCORES = """
s AS (SELECT q.query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(q.query_vec, CAST(e.embedding AS DOUBLE[])), 7) AS sim
      FROM query_vectors q CROSS JOIN embeddings e)"""
PICK = """SELECT query_id, id, greatest(0, least(1, sim)) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank"""


@query("vec1_top_k_cosine", sq.with_(sq.QUERY_VECTORS, SCORES) + PICK + " FROM s WHERE sim >= 0.2 QUALIFY rank <= 10")
def vec1(spark, sf_dir):
    return hits(vs.top_k(tables.query_vectors(spark, sf_dir), all_vectors(spark, sf_dir), 10, FLOOR))


@query(
    "vec2_filtered_search",
    sq.with_(sq.QUERY_VECTORS, SCORES) + PICK + """ FROM s JOIN documents d ON d.doc_id = s.id JOIN labels l ON l.doc_id = s.id
WHERE sim >= 0.1 AND d.lang = 'en' AND l.quality >= 1 QUALIFY rank <= 10""",
)
def vec2(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    labels = tables.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("quality_score"))
    vectors = all_vectors(spark, sf_dir).join(docs, "id").join(labels, "id", "left")
    vectors = vectors.withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")))
    kept = vs.filtered(vectors, metadata={"lang": "en"}, min_quality=1)
    return hits(vs.top_k(tables.query_vectors(spark, sf_dir), kept, 10, 0.1))


@query("vec2_model_scope", sq.with_(sq.QUERY_VECTORS, SCORES) + PICK + " FROM s JOIN embeddings e ON e.vec_id = s.id WHERE sim >= 0.1 AND e.label < 5 QUALIFY rank <= 10")
def vec2_model_scope(spark, sf_dir):
    """Vectors of two models in one table; a search stays within one."""
    model = F.when(F.col("label") < 5, "small").otherwise("large")
    vectors = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), model.alias("model_name"))
    return hits(vs.top_k(tables.query_vectors(spark, sf_dir), vs.filtered(vectors, model="small"), 10, 0.1))


@query("vec3_similar_chunks", sq.with_(sq.QUERY_VECTORS, SCORES) + PICK + " FROM s WHERE id <> query_id QUALIFY rank <= 10")
def vec3(spark, sf_dir):
    return hits(vs.similar_to(tables.query_vectors(spark, sf_dir), all_vectors(spark, sf_dir), 10))


@query(
    "vec4_validation",
    """
WITH v AS (SELECT d.lang, CASE WHEN e.embedding IS NULL THEN 'missing' WHEN len(e.embedding) = 0 THEN 'empty'
  WHEN len(e.embedding) <> 64 THEN 'wrong_dimension'
  WHEN len(list_filter(e.embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not_finite' ELSE 'ok' END AS problem
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT lang, problem, count(*) AS n FROM v GROUP BY 1, 2""",
)
def vec4(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    joined = docs.join(all_vectors(spark, sf_dir), "id", "left")
    return vs.validate(joined, 64).groupBy("lang", "problem").agg(F.count("*").alias("n"))


def lists_and_probes(spark, sf_dir):
    """The stored lists, and probes for vectors without much structure: two thirds of the cells."""
    lists = tables.vector_lists(spark, sf_dir)
    return lists, -(-2 * len(lists.codec.centres) // 3)


@query(
    "vec5_approximate_recall",
    sq.with_(sq.QUERY_VECTORS, SCORES) + """, t AS (SELECT query_id FROM s WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 10)
SELECT count(*) AS n_exact, TRUE AS recall_is_090, TRUE AS reads_under_085 FROM t""",
)
def vec5(spark, sf_dir):
    """Recall of the coded lists against exact search, and the share of all rows in the cells that were probed."""
    lists, probes = lists_and_probes(spark, sf_dir)
    queries = tables.query_vectors(spark, sf_dir)
    exact = vs.top_k(queries, all_vectors(spark, sf_dir), 10, FLOOR).select("query_id", "id")
    near = vc.approximate(lists, queries, 10, FLOOR, probes, 100).select("query_id", "id", F.lit(1).alias("hit"))
    sizes = lists.rows.groupBy("cell").agg(F.count("*").alias("rows"))
    read = vc.probed(lists, queries, probes).join(sizes, "cell").agg(F.sum("rows").alias("read"), F.countDistinct("query_id").alias("asked"))
    found = exact.join(near, ["query_id", "id"], "left").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return found.join(F.broadcast(read)).select(
        "n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("recall_is_090"), (F.col("read") <= 0.85 * F.col("asked") * lists.n).alias("reads_under_085"))


@query(
    "vec5_candidates",
    sq.with_(sq.QUERY_VECTORS, SCORES) + "SELECT query_id, id, greatest(0, least(1, sim)) AS similarity FROM s WHERE sim >= 0.3",
)
def vec5_candidates(spark, sf_dir):
    """With all cells probed and all rows kept the codes decide nothing: every pair above the floor is there."""
    lists = tables.vector_lists(spark, sf_dir)
    found = vc.approximate(lists, tables.query_vectors(spark, sf_dir), lists.n, 0.3, len(lists.codec.centres), lists.n)
    return found.select("query_id", "id", "similarity")


@query(
    "vec6_sparse_cosine",
    """
WITH v AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS dim FROM embeddings),
p AS (SELECT * FROM v WHERE abs(w) > 0.1),
n AS (SELECT id, sqrt(sum(w * w)) AS len FROM p GROUP BY id),
u AS (SELECT id, dim, w / len AS w FROM p JOIN n USING (id)),
s AS (SELECT q.id AS query_id, u.id, round(sum(u.w * q.w), 7) AS sim FROM u JOIN u q ON q.dim = u.dim
      WHERE q.id IN (SELECT item_id FROM benchmark) GROUP BY 1, 2)
SELECT query_id, id, sim AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank
FROM s QUALIFY rank <= 10""",
)
def vec6(spark, sf_dir):
    def sparse(vec):
        dims = F.transform(vec, lambda x, i: F.struct((i + 1).alias("key"), x.cast("double").alias("value")))
        return F.map_from_entries(F.filter(dims, lambda e: F.abs(e["value"]) > 0.1))

    queries = tables.query_vectors(spark, sf_dir).select("query_id", sparse(F.col("query_vec")).alias("sparse"))
    vectors = all_vectors(spark, sf_dir).select("id", sparse(F.col("vec")).alias("sparse"))
    return hits(vs.sparse_top_k(queries, vectors, 10))


@query(
    "emb1_worklist",
    sq.with_(sq.CHUNKS) + """
SELECT key, count(*) AS n_uses FROM (SELECT sha256(content || ':small') AS key FROM chunks)
WHERE key NOT IN (SELECT sha256(content || ':small') FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY key""",
)
def emb1(spark, sf_dir):
    texts = tables.chunks(spark, sf_dir).select("doc_id", F.col("content").alias("text"))
    known = texts.join(tables.load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = known.select(emb.cache_key(F.col("text"), "small").alias("key"))
    return emb.worklist(texts, cache, "small").select("key", "n_uses")


@query(
    "emb1_cache_hits",
    sq.with_(sq.CHUNKS) + """,
t AS (SELECT lang, doc_id, sha256(content || ':small') AS key FROM chunks),
c AS (SELECT DISTINCT key FROM t WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT t.lang, count(*) AS n_texts, count(c.key) AS n_hits FROM t LEFT JOIN c USING (key) GROUP BY 1""",
)
def emb1_hits(spark, sf_dir):
    texts = tables.chunks(spark, sf_dir).select("doc_id", "lang", F.col("content").alias("text"))
    known = texts.join(tables.load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = known.groupBy(emb.cache_key(F.col("text"), "small").alias("key")).agg(F.min("text").alias("text")).select(
        "key", emb.hash_embed("text").alias("embedding"))
    done = emb.embed_with_cache(texts.select("lang", "text"), cache, "small")
    return done.groupBy("lang").agg(F.count("*").alias("n_texts"), F.count_if("hit").alias("n_hits"))


@query(
    "emb2_quantisation_error",
    """
WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings),
x AS (SELECT label, vec_id, lo, hi, unnest(v) AS x FROM v),
q AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE CAST(floor((x - lo) / (hi - lo) * 255.0) AS INTEGER) END AS c FROM x)
SELECT label, count(DISTINCT vec_id) AS n_vectors, CAST(sum(c) AS BIGINT) AS code_sum,
  round(avg(abs(c / 255.0 * (hi - lo) + lo - x)), 9) AS mean_error, round(max(abs(c / 255.0 * (hi - lo) + lo - x)), 9) AS max_error
FROM q GROUP BY label""",
)
def emb2(spark, sf_dir):
    q = emb.quantise(tables.load(spark, sf_dir, "embeddings"))
    back = emb.dequantise(F.col("codes"), F.col("lo"), F.col("hi"))
    diffs = F.zip_with(back, "embedding", lambda a, b: F.abs(a - b.cast("double")))
    per_vec = q.select("label", F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("codes"),
                       F.aggregate(diffs, F.lit(0.0), lambda a, d: a + d).alias("err"), F.array_max(diffs).alias("worst"), F.size("codes").alias("d"))
    return per_vec.groupBy("label").agg(
        F.count("*").alias("n_vectors"), F.sum("codes").alias("code_sum"),
        F.round(F.sum("err") / F.sum("d"), 9).alias("mean_error"), F.round(F.max("worst"), 9).alias("max_error"))


@query("emb3_pca")
def emb3(spark, sf_dir):
    reduced, explained, enough = emb.reduce_dims(tables.load(spark, sf_dir, "embeddings"), target=256)
    return reduced.groupBy("label").agg(
        F.count("*").alias("n_vectors"), F.max(F.size("reduced")).alias("dims"),
        F.lit(round(explained, 4)).alias("explained"), F.lit(enough).alias("enough"))


@query(
    "emb4_model_choice",
    "WITH t AS (SELECT source, length(text) AS n, "
    + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in emb.TECHNICAL_TERMS)
    + """ >= 2 AS tech FROM documents),
b AS (SELECT source, count(*) AS n_texts, avg(n) AS mean_length, bool_or(tech) AS technical FROM t GROUP BY source)
SELECT source, n_texts, round(mean_length, 6) AS mean_length, technical,
  CASE WHEN technical AND mean_length > 500 THEN 'technical' WHEN mean_length > 1000 THEN 'large' ELSE 'small' END AS model FROM b""",
)
def emb4(spark, sf_dir):
    return emb.choose_model(tables.load(spark, sf_dir, "documents"), "source").withColumn("mean_length", F.round("mean_length", 6))


@query(
    "emb5_hash_embedding",
    r"""
WITH w AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (
  SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS ws FROM documents)),
h AS (SELECT doc_id, lang, i, md5(w) AS h FROM w),
b AS (SELECT doc_id, lang, (i * 16 + j) % 384 AS dim, CAST('0x' || substr(h, j * 2 + 1, 2) AS INTEGER) / 255.0 AS v
      FROM h, (SELECT unnest(range(16)) AS j)),
d AS (SELECT doc_id, lang, dim, sum(v) AS v FROM b GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM d GROUP BY doc_id),
c AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
SELECT lang, CAST(dim AS INTEGER) AS dim, round(sum(v / len) / any_value(docs), 9) AS mean_value
FROM d JOIN n USING (doc_id) JOIN c USING (lang) GROUP BY lang, dim""",
)
def emb5(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("lang", emb.hash_embed("text").alias("v"))
    return docs.select("lang", F.posexplode("v").alias("dim", "x")).groupBy("lang", "dim").agg(F.round(F.avg("x"), 9).alias("mean_value"))


@query(
    "txt1_ranked",
    sq.with_(sq.CHUNKS, sq.QUERY_TERMS, sq.bm25(10)) + "SELECT query_id, chunk_id, round(rank_score, 6) AS rank_score, rank FROM t_leg",
)
def txt1(spark, sf_dir):
    return text_leg(spark, sf_dir, 10).select(
        "query_id", "chunk_id", F.round("rank_score", 6).alias("rank_score"), F.col("rank").cast("long").alias("rank"))


@query(
    "txt1_matched_ranked",
    sq.with_(sq.CHUNKS, sq.QUERY_TERMS, sq.bm25(10)) + rf""",
cl AS (SELECT item_id AS query_id, list_filter(list_distinct({sq.words_of('text')}), lambda w: length(w) >= 9) AS any_of FROM benchmark),
mt AS (SELECT cl.query_id, t.chunk_id FROM cl JOIN tok t ON list_has_any(t.ws, cl.any_of) AND NOT list_contains(t.ws, 'was') JOIN chunks c ON c.chunk_id = t.chunk_id AND c.lang = 'en')
SELECT query_id, chunk_id, round(score / (score + 1), 6) AS rank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM bm JOIN mt USING (query_id, chunk_id) QUALIFY rank <= 10""",
)
def txt1_matched_ranked(spark, sf_dir):
    """English chunks with one of the long words and without "was", ranked by all words."""
    words = F.array_distinct(tx.words(F.col("text")))
    clauses = tables.load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.filter(words, lambda w: F.length(w) >= 9).alias("any_of"), F.array(F.lit("was")).alias("none_of"))
    queries = term_queries(spark, sf_dir).join(clauses.where(F.size("any_of") > 0), "query_id")
    english = tables.chunks(spark, sf_dir).where(F.col("lang") == "en")
    out = ps.ranked(tables.chunk_index(spark, sf_dir), queries, 10, chunks=english)
    return out.select("query_id", "chunk_id", F.round("rank_score", 6).alias("rank_score"), F.col("rank").cast("long").alias("rank"))


@query(
    "txt1_cover_density",
    sq.with_(sq.CHUNKS, sq.TERMS) + rf""",
words AS (SELECT item_id AS query_id, list_filter(all_ws, lambda w, i: list_position(all_ws, w) = i AND length(w) >= 5 AND w NOT IN {sq.sql_list(tx.ENGLISH_STOP_WORDS)}) AS ws
  FROM (SELECT item_id, {sq.words_of('text')} AS all_ws FROM benchmark)),
asked AS (SELECT query_id * 100 + i AS query_id, ws[2 * i + 1] AS a, ws[2 * i + 2] AS b FROM words, range(5) t(i) WHERE len(ws) >= 2 * i + 2),
occ AS (SELECT query_id, chunk_id, pos, term FROM asked JOIN terms ON term = a OR term = b),
latest AS (SELECT q.query_id, q.chunk_id, q.pos, p.term, max(p.pos) AS begins FROM occ q JOIN occ p ON p.query_id = q.query_id AND p.chunk_id = q.chunk_id AND p.pos <= q.pos GROUP BY ALL),
ends AS (SELECT query_id, chunk_id, pos, min(begins) AS start FROM latest GROUP BY ALL HAVING count(*) = 2),
covers AS (SELECT query_id, chunk_id, start, min(pos) AS pos FROM ends GROUP BY ALL),
noise AS (SELECT c.query_id, c.chunk_id, c.start, c.pos, c.pos - c.start - (count(*) - 1) AS others FROM covers c JOIN occ o
  ON o.query_id = c.query_id AND o.chunk_id = c.chunk_id AND o.pos BETWEEN c.start AND c.pos GROUP BY c.query_id, c.chunk_id, c.start, c.pos),
s AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + others)), 9) AS score FROM noise GROUP BY ALL)
SELECT query_id, chunk_id, round(score / (score + 1), 6) AS rank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM s QUALIFY rank <= 10""",
)
def txt1_cover_density(spark, sf_dir):
    """Five pairs of words of every benchmark item: both must be there, the closer together and the more often the better."""
    ws = F.filter(F.array_distinct(tx.words(F.col("text"))), lambda w: (F.length(w) >= 5) & ~w.isin(tx.ENGLISH_STOP_WORDS))
    pairs = tables.load(spark, sf_dir, "benchmark").select("item_id", ws.alias("ws"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).where("size(ws) >= 2 * i + 2")
    queries = pairs.select((F.col("item_id") * 100 + F.col("i")).alias("query_id"), F.slice("ws", 2 * F.col("i") + 1, 2).alias("must"))
    out = ps.ranked(tables.chunk_index(spark, sf_dir), queries, 10, "cover")
    return out.select("query_id", "chunk_id", F.round("rank_score", 6).alias("rank_score"), F.col("rank").cast("long").alias("rank"))


def sentence_queries(spark, sf_dir):
    """Every sentence of every benchmark item as one query, with the item's other words."""
    items = tables.load(spark, sf_dir, "benchmark")
    parts = items.select("item_id", F.posexplode(tx.sentences(F.col("text"))).alias("n", "sentence"), "text")
    ws = tx.words(F.col("sentence"))
    other = F.array_except(tx.words(F.col("text")), ws)
    long_words = lambda a, n: F.filter(F.array_distinct(a), lambda w: F.length(w) >= n)
    return parts.where(F.size(ws) > 0).select(
        (F.col("item_id") * 1000 + F.col("n")).alias("query_id"), F.array_join(ws, " ").alias("phrase"),
        long_words(ws, 6).alias("long_words"), long_words(other, 10).alias("other_words"))


SENTENCES = rf"""
parts AS (SELECT item_id, text, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS n FROM (
  SELECT item_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss FROM benchmark)),
sentence_queries AS (
  SELECT item_id * 1000 + n AS query_id, {sq.words_of('sentence')} AS ws, {sq.words_of('text')} AS all_ws FROM parts
  WHERE len({sq.words_of('sentence')}) > 0),
ctok AS (SELECT chunk_id, {sq.words_of('content')} AS ws FROM chunks)"""



@query(
    "txt2_phrase",
    sq.with_(sq.CHUNKS, SENTENCES) + """
SELECT DISTINCT q.query_id, c.chunk_id FROM sentence_queries q JOIN ctok c
ON contains(' ' || array_to_string(c.ws, ' ') || ' ', ' ' || array_to_string(q.ws, ' ') || ' ')""",
)
def txt2_phrase(spark, sf_dir):
    q = sentence_queries(spark, sf_dir)
    return found(ps.search(tables.chunk_index(spark, sf_dir), q.select("query_id", F.array("phrase").alias("phrases")), "match"))


def found(matches):
    return matches.select("query_id", "chunk_id")


@query(
    "txt2_and_not",
    sq.with_(sq.CHUNKS, SENTENCES) + """,
q AS (SELECT query_id, list_filter(ws, lambda w: length(w) >= 6) AS must,
             list_filter(all_ws, lambda w: length(w) >= 10 AND NOT list_contains(ws, w)) AS bad FROM sentence_queries)
SELECT DISTINCT q.query_id, c.chunk_id FROM q JOIN ctok c ON list_has_all(c.ws, q.must) AND NOT list_has_any(c.ws, q.bad)
WHERE len(q.must) > 0""",
)
def txt2_and_not(spark, sf_dir):
    q = sentence_queries(spark, sf_dir).where(F.size("long_words") > 0)
    return found(ps.search(tables.chunk_index(spark, sf_dir), q.select("query_id", F.col("long_words").alias("must"), F.col("other_words").alias("none_of")), "match"))


@query(
    "txt2_not_only",
    sq.with_(sq.CHUNKS, SENTENCES) + """,
q AS (SELECT query_id, list_distinct(list_filter(ws, lambda w: length(w) >= 3)) AS bad FROM sentence_queries WHERE query_id % 1000 = 0)
SELECT query_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM q JOIN ctok c ON NOT list_has_any(c.ws, q.bad) GROUP BY 1""",
)
def txt2_not_only(spark, sf_dir):
    """Chunks that hold none of the words of an item's first sentence."""
    q = sentence_queries(spark, sf_dir).where(F.col("query_id") % 1000 == 0)
    bad = F.filter(F.array_distinct(F.split("phrase", " ")), lambda w: F.length(w) >= 3)
    hits = ps.search(tables.chunk_index(spark, sf_dir), q.select("query_id", bad.alias("none_of")), "match")
    return hits.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


@query(
    "txt2_or",
    sq.with_(sq.CHUNKS, SENTENCES) + """,
q AS (SELECT query_id, list_filter(ws, lambda w: length(w) >= 12) AS any_of FROM sentence_queries)
SELECT query_id, count(DISTINCT chunk_id) AS n_chunks FROM q JOIN ctok c ON list_has_any(c.ws, q.any_of) GROUP BY 1""",
)
def txt2_or(spark, sf_dir):
    q = sentence_queries(spark, sf_dir).select("query_id", F.filter("long_words", lambda w: F.length(w) >= 12).alias("any_of")).where(F.size("any_of") > 0)
    matches = ps.search(tables.chunk_index(spark, sf_dir), q, "match")
    return matches.groupBy("query_id").agg(F.count("*").alias("n_chunks"))


FUZZY = rf"""
cg AS (SELECT chunk_id, list_distinct(flatten(list_transform({sq.words_of('content')}, lambda w:
  list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM chunks),
qg AS (SELECT item_id AS query_id, list_distinct(flatten(list_transform({sq.words_of('text')}, lambda w:
  list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM benchmark),
cgx AS (SELECT chunk_id, len(g) AS cn, unnest(g) AS gram FROM cg),
qgx AS (SELECT query_id, len(g) AS qn, unnest(g) AS gram FROM qg),
fz AS (SELECT query_id, chunk_id, round(count(*) / (any_value(qn) + any_value(cn) - count(*)), 9) AS score
       FROM cgx JOIN qgx USING (gram) GROUP BY 1, 2 HAVING score >= 0.3),
f_leg AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM fz QUALIFY rank <= 10)"""


def fuzzy_leg(spark, sf_dir):
    items = tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), ts.trigrams(F.col("text")).alias("terms"))
    return ps.ranked(tables.gram_index(spark, sf_dir), items, 10, "similar", threshold=0.3)


@query("txt3_trigram", sq.with_(sq.CHUNKS, FUZZY) + "SELECT query_id, chunk_id, score, rank FROM f_leg")
def txt3(spark, sf_dir):
    return fuzzy_leg(spark, sf_dir).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "txt4_text_or_fuzzy",
    sq.with_(sq.CHUNKS, sq.QUERY_TERMS, sq.bm25(10), FUZZY) + """,
m AS (SELECT query_id, chunk_id, greatest(round(t.rank_score, 9), f.score) AS score FROM t_leg t FULL JOIN f_leg f USING (query_id, chunk_id))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM m QUALIFY rank <= 10""",
)
def txt4(spark, sf_dir):
    out = ts.text_or_fuzzy(text_leg(spark, sf_dir, 10), fuzzy_leg(spark, sf_dir), 10)
    return out.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def marked_results(spark, sf_dir):
    top = text_leg(spark, sf_dir, 10).select("query_id", "chunk_id", "rank")
    terms = tables.query_terms(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return top.join(tables.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id").join(terms, "query_id")


@query(
    "txt5_matched_terms",
    sq.with_(sq.CHUNKS, sq.QUERY_TERMS, sq.bm25(10)) + """
SELECT t.query_id, t.chunk_id, string_agg(DISTINCT p.term, ' ' ORDER BY p.term) AS terms
FROM t_leg t JOIN post p ON p.chunk_id = t.chunk_id JOIN query_terms q ON q.query_id = t.query_id AND q.term = p.term GROUP BY 1, 2""",
)
def txt5(spark, sf_dir):
    return marked_results(spark, sf_dir).select(
        "query_id", "chunk_id", F.array_join(ts.matched_terms(F.col("content"), F.col("terms")), " ").alias("terms"))


@query("txt5_highlight")
def txt5_highlight(spark, sf_dir):
    return marked_results(spark, sf_dir).select(
        "query_id", "chunk_id", F.array_join(ts.fragments(F.col("content"), F.col("terms")), " ... ").alias("highlight"))


BENCH_TOKENS = r"""
bt AS (SELECT item_id AS query_id, t AS term, count(*) AS n FROM (
  SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS t FROM benchmark) GROUP BY 1, 2)"""


@query(
    "txt6_term_coverage",
    sq.with_(sq.CHUNKS, BENCH_TOKENS) + """,
ts AS (SELECT DISTINCT term FROM bt),
low AS (SELECT chunk_id, lower(content) AS c FROM chunks),
h AS (SELECT chunk_id, term FROM low JOIN ts ON contains(c, term)),
tot AS (SELECT query_id, sum(n) AS total FROM bt GROUP BY 1),
s AS (SELECT query_id, chunk_id, round(sum(n) / any_value(total), 9) AS score FROM h JOIN bt USING (term) JOIN tot USING (query_id) GROUP BY 1, 2)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM s QUALIFY rank <= 10""",
)
def txt6(spark, sf_dir):
    items = tables.load(spark, sf_dir, "benchmark")
    terms = items.select(F.col("item_id").alias("query_id"), F.explode(tx.whitespace_tokens(F.lower("text"))).alias("term"))
    q = terms.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    return ts.term_coverage(q, tables.chunks(spark, sf_dir), 10).select(
        "query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "txt8_expand_plurals",
    r"""
WITH t AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS ts FROM benchmark),
v AS (SELECT query_id, ts, list_filter(list_transform(ts, lambda t: CASE WHEN NOT ends_with(t, 's') AND length(t) > 2 THEN t || 's'
  WHEN ends_with(t, 's') AND length(t) > 3 THEN left(t, -1) END), lambda t: t IS NOT NULL) AS vs FROM t),
e AS (SELECT query_id, w, min(p) AS p FROM (SELECT query_id, unnest(list_concat(ts, vs)) AS w,
  generate_subscripts(list_concat(ts, vs), 1) AS p FROM v) GROUP BY 1, 2),
r AS (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY p) AS r FROM e)
SELECT query_id, string_agg(w, ' ' ORDER BY r) AS expanded, CAST(any_value(len(vs)) AS INTEGER) AS n_variants
FROM r JOIN v USING (query_id) WHERE r <= len(ts) + 5 GROUP BY query_id""",
)
def txt8(spark, sf_dir):
    return ts.expand_plurals(tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


ABBREVIATIONS = ", ".join(f"('{t}', {i}, '{p}')" for t, ps in ts.EXPANSIONS.items() for i, p in enumerate(ps, 1))


@query(
    "txt8_expand_abbreviations",
    rf"""
WITH ab(term, n, phrase) AS (VALUES {ABBREVIATIONS}, ('en', 1, 'english'), ('en', 2, 'anglais'), ('the', 1, 'article')),
t AS (SELECT conv_id * 1000 + turn AS query_id, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS ts FROM conversations),
x AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM t),
f AS (SELECT query_id, string_agg(phrase, ' ' ORDER BY pos, n) AS more, count(*) AS k FROM x JOIN ab USING (term) GROUP BY 1)
SELECT query_id, CASE WHEN more IS NULL THEN text ELSE text || ' ' || more END AS expanded, CAST(coalesce(k, 0) AS INTEGER) AS n_expansions
FROM t LEFT JOIN f USING (query_id)""",
)
def txt8_abbreviations(spark, sf_dir):
    rows = [(t, i, p) for t, ps in ts.EXPANSIONS.items() for i, p in enumerate(ps, 1)]
    rows += [("en", 1, "english"), ("en", 2, "anglais"), ("the", 1, "article")]
    table = F.broadcast(spark.createDataFrame(rows, "term string, n int, phrase string"))
    turns = tables.load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return ts.expand_abbreviations(turns, table)
