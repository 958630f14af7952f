"""SQL fragments (common table expressions) shared by the oracle statements."""

from __future__ import annotations

from docloom.functions.text import ENGLISH_STOP_WORDS


def sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def words_of(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]+')"


CHUNKS = """
chunks AS (
  SELECT doc_id, lang, source, CAST(i AS INTEGER) AS chunk_index, doc_id * 1000000 + i AS chunk_id,
         i * 800 AS start_char, least(i * 800 + 1000, length(text)) AS end_char,
         substr(text, i * 800 + 1, 1000) AS content,
         sha256(substr(text, i * 800 + 1, 1000)) AS content_hash
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i
        FROM documents WHERE length(text) > 0)
)"""

QUERY_TERMS = f"""
query_terms AS (
  SELECT DISTINCT query_id, term FROM (
    SELECT item_id AS query_id, unnest({words_of('text')}) AS term FROM benchmark)
  WHERE term NOT IN {sql_list(ENGLISH_STOP_WORDS)}
)"""

TERMS = f"""
terms AS (
  SELECT chunk_id, doc_id, w AS term, pos FROM (
    SELECT chunk_id, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
    FROM (SELECT chunk_id, doc_id, {words_of('content')} AS ws FROM chunks))
)"""

QUERY_VECTORS = """
query_vectors AS (
  SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query_vec
  FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


MENTIONS = f"""
mentions AS (
  SELECT DISTINCT chunk_id, doc_id, w AS entity_text, 'concept' AS entity_type, 0.6 AS confidence
  FROM (SELECT chunk_id, doc_id, unnest({words_of('content')}) AS w FROM chunks)
  WHERE w NOT IN {sql_list(ENGLISH_STOP_WORDS)}
)"""


def bm25(k: int) -> str:
    """``t_leg``: the k best chunks of every query (needs chunks and query_terms)."""
    return f"""
tok AS (SELECT chunk_id, ws, len(ws) AS dl FROM (SELECT chunk_id, {words_of('content')} AS ws FROM chunks)),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT chunk_id, dl, unnest(ws) AS term FROM tok) GROUP BY 1, 2),
dfq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm AS (
  SELECT query_id, chunk_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 7) AS score
  FROM query_terms JOIN dfq USING (term) JOIN post USING (term), st GROUP BY 1, 2),
t_leg AS (
  SELECT query_id, chunk_id, score, score / (score + 1) AS rank_score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM bm QUALIFY rank <= {k})"""


def vector_leg(k: int, floor: float) -> str:
    """``v_leg``: the k nearest chunks of every query (needs chunks and query_vectors)."""
    return f"""
vec_scores AS (
  SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(q.query_vec, CAST(e.embedding AS DOUBLE[])), 7) AS sim
  FROM chunks c JOIN embeddings e ON c.doc_id = e.vec_id CROSS JOIN query_vectors q),
v_leg AS (
  SELECT query_id, chunk_id, greatest(0, least(1, sim)) AS similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank
  FROM vec_scores WHERE sim >= {floor} QUALIFY rank <= {k})"""
