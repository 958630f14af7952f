"""Quality, enrichment and entity queries over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import tables
from docloom.operators import enrichment as en
from docloom.operators import entities as ent
from docloom.operators import quality as qa
from docloom.plans import fragments as sq
from docloom.plans.evaluation import rounded
from docloom.plans.registry import query

DOCS = rf"""
ch AS (SELECT doc_id, c, i, sum(CASE WHEN c = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, c, i, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (
    SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, string_split(text, '') AS cs FROM documents)))),
rep AS (SELECT DISTINCT doc_id FROM ch WHERE c <> chr(10) GROUP BY doc_id, run HAVING count(*) >= 11),
b AS (
  SELECT d.doc_id, lang, source, text, length(text) AS n,
    len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS w,
    (2 * length(text) - length(regexp_replace(text, '[\x00-\x08\x0b-\x0c\x0e-\x1f]', '', 'g')) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / length(text) AS g,
    coalesce(list_avg(list_transform(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]{{2,}}')), lambda x: length(x))), 0) AS m,
    r.doc_id IS NOT NULL AS repeated, len(string_split(text, chr(10))) AS lines
  FROM documents d LEFT JOIN rep r ON r.doc_id = d.doc_id),
tq AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - g * 2 - CASE WHEN n < 100 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN m > 15 THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN repeated THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN w > 0 AND w / lines > 50 THEN 0.1::DOUBLE ELSE 0 END)) AS score FROM b)"""


@query(
    "qua1_text_quality",
    "WITH" + DOCS + """ SELECT doc_id, round(score, 6) AS score, CAST(n AS INTEGER) AS char_count, CAST(w AS INTEGER) AS word_count,
round(m, 6) AS mean_word_length, round(g, 6) AS garbage_ratio FROM tq""",
)
def qua1(spark, sf_dir):
    out = qa.text_quality(tables.load(spark, sf_dir, "documents")).select(
        "doc_id", "tq.score", "tq.char_count", "tq.word_count", "tq.mean_word_length", "tq.garbage_ratio")
    return rounded(out, "score", "mean_word_length", "garbage_ratio")


@query(
    "qua1_report",
    "WITH" + DOCS + """ SELECT coalesce(lang, 'all') AS lang, count(*) AS n_docs, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score,
count(*) FILTER (repeated) AS n_repeated, count(*) FILTER (n < 100) AS n_short FROM tq GROUP BY ROLLUP (lang)""",
)
def qua1_report(spark, sf_dir):
    scored = qa.text_quality(tables.load(spark, sf_dir, "documents"))
    out = scored.rollup("lang").agg(
        F.count("*").alias("n_docs"), F.avg("tq.score").alias("mean_score"), F.min("tq.score").alias("min_score"),
        F.count_if(F.array_contains("tq.issues", "repeated_characters")).alias("n_repeated"),
        F.count_if(F.array_contains("tq.issues", "very_short")).alias("n_short"))
    return rounded(out.withColumn("lang", F.coalesce("lang", F.lit("all"))), "mean_score", "min_score")


def parsed(spark, sf_dir):
    """Documents as parsing results: lines are pages, labels are metadata and confidence."""
    docs = tables.load(spark, sf_dir, "documents").withColumn("pages", F.split("text", "\n"))
    labels = tables.load(spark, sf_dir, "labels")
    out = docs.join(labels, "doc_id", "left").withColumn("has_metadata", F.col("quality").isNotNull())
    return out.withColumn("confidence", F.when(F.col("quality") == 1, 0.95).when(F.col("quality") == 0, 0.4).otherwise(0.8))


SQ = "WITH" + DOCS + r""",
pg AS (SELECT tq.*, list_transform(string_split(text, chr(10)), lambda p: length(p)) AS ls,
  len(list_filter(string_split(text, chr(10)), lambda p: length(regexp_replace(p, '^\s+|\s+$', '', 'g')) > 10)) AS filled,
  l.doc_id IS NOT NULL AS meta, toxic, CASE WHEN quality = 1 THEN 0.95 WHEN quality = 0 THEN 0.4 ELSE 0.8 END::DOUBLE AS conf
  FROM tq LEFT JOIN labels l ON l.doc_id = tq.doc_id),
st AS (SELECT *, len(list_filter(ls, lambda x: x < 10)) AS empty_pages, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  1.0::DOUBLE - len(list_filter(ls, lambda x: x < 10)) / len(ls) * 0.3::DOUBLE - CASE WHEN meta THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END)) AS sscore FROM pg),
ov AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CASE WHEN w < 10 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * 0.5::DOUBLE + filled / len(ls) * 0.5::DOUBLE END AS compl FROM st),
oo AS (SELECT *, score * 0.4::DOUBLE + sscore * 0.3::DOUBLE + conf * 0.2::DOUBLE + compl * 0.1::DOUBLE AS overall FROM ov)"""


@query(
    "qua2_structure",
    SQ + """ SELECT doc_id, round(sscore, 6) AS score, CAST(len(ls) AS INTEGER) AS page_count, CAST(empty_pages AS INTEGER) AS empty_pages,
round(list_avg(ls), 6) AS mean_page_length, list_max(ls) > 0 AND coalesce(list_min(ls) / nullif(list_max(ls), 0) < 0.1, false) AS uneven_pages FROM st""",
)
def qua2(spark, sf_dir):
    out = qa.structure_quality(parsed(spark, sf_dir)).select("doc_id", "sq.*")
    return rounded(out, "score", "mean_page_length").withColumn("uneven_pages", F.coalesce("uneven_pages", F.lit(False)))


@query(
    "qua3_assessment",
    SQ + """ SELECT doc_id, round(overall, 6) AS overall, round(compl, 6) AS completeness, overall >= 0.7 AS passed, overall < 0.5 AS needs_retry,
CASE WHEN overall >= 0.5 AND g <= 0.1 AND m <= 15 AND empty_pages = 0 AND conf >= 0.7 THEN CASE WHEN overall < 0.9 THEN 'minor_issues' ELSE '' END
ELSE concat_ws(',', CASE WHEN overall < 0.5 THEN 'retry_with_fallback' END, CASE WHEN g > 0.1 THEN 'high_garbage_ratio' END,
  CASE WHEN m > 15 THEN 'concatenated_words' END, CASE WHEN empty_pages > 0 THEN 'empty_pages' END, CASE WHEN conf < 0.7 THEN 'low_confidence' END) END AS recommendations FROM oo""",
)
def qua3(spark, sf_dir):
    out = assessed(spark, sf_dir).select(
        "doc_id", "overall", "completeness", "passed", "needs_retry", F.array_join("recommendations", ",").alias("recommendations"))
    return rounded(out, "overall", "completeness")


def assessed(spark, sf_dir):
    return qa.assess(qa.structure_quality(qa.text_quality(parsed(spark, sf_dir))))


@query(
    "qua4_retry_plan",
    SQ + """,
a AS (SELECT *, CASE WHEN toxic = 1 THEN 3 WHEN meta THEN 2 ELSE 1 END AS attempt, CASE WHEN lang = 'de' THEN 'ocr' ELSE 'layout' END AS parser FROM oo),
p AS (SELECT *, attempt < 3 AND overall < 0.7 AS should_retry,
  CASE WHEN NOT (attempt < 3 AND overall < 0.7) THEN 'none' WHEN score < 0.3 AND parser <> 'ocr' THEN 'fallback_parser' WHEN conf < 0.5 THEN 'fallback_parser' ELSE 'same_parser' END AS strategy,
  CASE WHEN overall < 0.3 THEN 'fallback_parser' WHEN overall < 0.5 THEN CASE WHEN attempt < 2 THEN 'fallback_parser' ELSE 'same_parser' END ELSE 'none' END AS rule_strategy FROM a)
SELECT strategy, rule_strategy, count(*) AS n_docs, round(avg(overall), 6) AS mean_overall FROM p GROUP BY 1, 2""",
)
def qua4(spark, sf_dir):
    attempt = F.when(F.col("toxic") == 1, 3).when(F.col("has_metadata"), 2).otherwise(1)
    docs = assessed(spark, sf_dir).withColumn("attempt", attempt).withColumn(
        "parser", F.when(F.col("lang") == "de", "ocr").otherwise("layout"))
    docs = docs.withColumn("text_score", F.col("tq.score")).withColumn("tried_fallback", F.col("attempt") >= 2)
    return qa.plan_retries(docs).groupBy("strategy", "rule_strategy").agg(
        F.count("*").alias("n_docs"), F.round(F.avg("overall"), 6).alias("mean_overall"))


PAGES = """
pp AS (SELECT l_orderkey AS doc_id, l_linenumber, l_discount * 10 AS tr, l_tax * 12.5 AS ir,
  CASE WHEN l_discount = 0 THEN 0 ELSE CAST(l_quantity AS INTEGER) * 40 END AS chars, CASE WHEN l_tax < 0.04 THEN 0 ELSE l_linenumber END AS imgs FROM lineitem)"""


def page_stats(spark, sf_dir):
    """Page statistics derived from order lines: one line is one page."""
    return tables.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_discount") * 10).alias("text_ratio"), (F.col("l_tax") * 12.5).alias("image_ratio"),
        F.when(F.col("l_discount") == 0, 0).otherwise(F.col("l_quantity").cast("int") * 40).alias("char_count"),
        F.when(F.col("l_tax") < 0.04, 0).otherwise(F.col("l_linenumber")).alias("image_count"))


@query(
    "qua5_page_types",
    "WITH" + PAGES + """ SELECT CASE WHEN tr > 0.85 THEN 'text' WHEN tr < 0.05 AND ir > 0.9 THEN 'scanned' ELSE 'mixed' END AS page_type, count(*) AS n_pages,
round(avg(CASE WHEN tr > 0.85 THEN least(1.0::DOUBLE, tr) WHEN tr < 0.05 AND ir > 0.9 THEN least(1.0::DOUBLE, ir) ELSE 0.5 + abs(tr - 0.5) END), 6) AS mean_confidence FROM pp GROUP BY 1""",
)
def qua5(spark, sf_dir):
    return qa.classify_page(page_stats(spark, sf_dir)).groupBy("page_type").agg(
        F.count("*").alias("n_pages"), F.round(F.avg("page_confidence"), 6).alias("mean_confidence"))


DOC_TYPES = PAGES + """,
dd AS (SELECT doc_id, count(*) AS n_pages, avg(CASE WHEN chars > 0 THEN 1.0::DOUBLE ELSE 0 END) AS t, avg(CASE WHEN imgs > 0 THEN 1.0::DOUBLE ELSE 0 END) AS i,
  sum(chars) AS c, sum(imgs) AS im FROM pp GROUP BY 1),
dt AS (SELECT *, CASE WHEN t > 0.95 THEN 'text' WHEN t < 0.05 AND i > 0.9 THEN 'scanned' WHEN t > 0 AND i > 0 THEN 'mixed' WHEN c > 0 THEN 'text'
  WHEN im > 0 THEN 'scanned' ELSE 'unknown' END AS doc_type, greatest(0.5::DOUBLE, least(1.0::DOUBLE, 0.9::DOUBLE - CASE WHEN n_pages < 3 THEN 0.1::DOUBLE ELSE 0 END
  - CASE WHEN t > 0.1 AND t < 0.9 AND i > 0.1 AND i < 0.9 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN c < 100 THEN 0.1::DOUBLE ELSE 0 END)) AS conf FROM dd)"""


@query(
    "qua5_document_types",
    "WITH" + DOC_TYPES + " SELECT doc_type, count(*) AS n_docs, CAST(sum(n_pages) AS BIGINT) AS n_pages, round(avg(conf), 6) AS mean_confidence FROM dt GROUP BY 1",
)
def qua5_docs(spark, sf_dir):
    return qa.classify_document(page_stats(spark, sf_dir)).groupBy("doc_type").agg(
        F.count("*").alias("n_docs"), F.sum("n_pages").alias("n_pages"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(
    "qua6_parser_plan",
    "WITH" + DOC_TYPES + """,
p AS (SELECT *, CASE WHEN conf >= 0.7 AND doc_type = 'scanned' THEN 'ocr' ELSE 'layout' END AS prim FROM dt)
SELECT coalesce(doc_type, 'all') AS doc_type, coalesce(prim, 'all') AS parser, count(*) AS n_docs,
  round(sum(n_pages * CASE WHEN prim = 'ocr' THEN 0.0105::DOUBLE ELSE 0.006::DOUBLE END), 4) AS cost,
  round(sum(n_pages * CASE WHEN prim = 'ocr' THEN 5.5::DOUBLE ELSE 1.5::DOUBLE END), 4) AS seconds
FROM (SELECT doc_type, prim, n_pages FROM p) GROUP BY ROLLUP (doc_type, prim)""",
)
def qua6(spark, sf_dir):
    plan = qa.parser_plan(qa.classify_document(page_stats(spark, sf_dir)))
    out = plan.rollup("doc_type", F.col("primary").alias("parser")).agg(
        F.count("*").alias("n_docs"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sum("seconds"), 4).alias("seconds"))
    return out.withColumn("doc_type", F.coalesce("doc_type", F.lit("all"))).withColumn("parser", F.coalesce("parser", F.lit("all")))


@query(
    "qua6_time_by_size",
    """
WITH f AS (SELECT CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'docx' WHEN 'fr' THEN 'xlsx' ELSE 'image' END AS file_type,
  CASE WHEN lang = 'es' THEN 'ocr' ELSE 'layout' END AS parser, n_chars AS size_bytes FROM documents),
r(parser, file_type, rate) AS (VALUES ('layout', 'pdf', 0.5), ('layout', 'docx', 1.0), ('layout', 'pptx', 0.3), ('layout', 'xlsx', 2.0), ('ocr', 'pdf', 0.2), ('ocr', 'image', 0.1))
SELECT parser, file_type, count(*) AS n_files, round(sum(greatest(size_bytes / 1048576.0 / coalesce(rate, 0.5) + 0.5, 0.1)), 6) AS seconds
FROM f LEFT JOIN r USING (parser, file_type) GROUP BY 1, 2""",
)
def qua6_time(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "de", "docx").when(F.col("lang") == "fr", "xlsx").otherwise("image")
    files = tables.load(spark, sf_dir, "documents").select(
        kind.alias("file_type"), F.when(F.col("lang") == "es", "ocr").otherwise("layout").alias("parser"), F.col("n_chars").alias("size_bytes"))
    return qa.time_by_size(files).groupBy("parser", "file_type").agg(
        F.count("*").alias("n_files"), F.round(F.sum("seconds"), 6).alias("seconds"))


# Frequent corpus words stand in for the lexicon, so scores vary over the whole corpus.
CORPUS_POSITIVE = en.POSITIVE + ["the", "les", "die", "los", "est", "ist"]
CORPUS_NEGATIVE = en.NEGATIVE + ["and", "dans", "und", "por", "not", "nicht"]


@query(
    "enr1_sentiment",
    f"""
WITH w AS (SELECT doc_id, lang, {sq.words_of('text')} AS ws FROM documents),
c AS (SELECT doc_id, lang, len(list_filter(ws, lambda x: x IN {sq.sql_list(CORPUS_POSITIVE)})) AS pos, len(list_filter(ws, lambda x: x IN {sq.sql_list(CORPUS_NEGATIVE)})) AS neg FROM w),
s AS (SELECT *, CASE WHEN pos + neg = 0 THEN 0 ELSE greatest(-1, least(1, (pos - neg) / greatest(pos + neg, 10))) END AS s,
  CASE WHEN pos + neg = 0 THEN 0.5 ELSE least((pos + neg) / 20.0, 0.9) END AS conf FROM c)
SELECT lang, CASE WHEN s > 0.6 THEN 'very_positive' WHEN s > 0.2 THEN 'positive' WHEN s < -0.6 THEN 'very_negative' WHEN s < -0.2 THEN 'negative' ELSE 'neutral' END AS label,
  count(*) AS n_docs, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg, round(avg(s), 6) AS mean_score, round(avg(conf), 6) AS mean_confidence FROM s GROUP BY 1, 2""",
)
def enr1(spark, sf_dir):
    scored = en.sentiment(tables.load(spark, sf_dir, "documents"), CORPUS_POSITIVE, CORPUS_NEGATIVE)
    return scored.groupBy("lang", "label").agg(
        F.count("*").alias("n_docs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.round(F.avg("sentiment"), 6).alias("mean_score"), F.round(F.avg("sentiment_confidence"), 6).alias("mean_confidence"))


CORPUS_TOPICS = {**en.TOPICS, "corpus": ["tion", "eau", "sch", "ado", "ing"]}
_TOPIC_STRUCTS = ", ".join(
    "{'name': '" + name + "', 'ord': " + str(i) + ", 's': " + " + ".join(f"CAST(contains(lower(text), '{k.lower()}') AS INTEGER)" for k in keys) + "}"
    for i, (name, keys) in enumerate(CORPUS_TOPICS.items()))


@query(
    "enr2_topics",
    f"""
WITH t AS (SELECT doc_id, lang, unnest([{_TOPIC_STRUCTS}]) AS x FROM documents),
r AS (SELECT doc_id, x.name AS name, x.s AS s, row_number() OVER (PARTITION BY doc_id ORDER BY x.s DESC, x.ord) AS r FROM t WHERE x.s > 0),
p AS (SELECT doc_id, max(name) FILTER (r = 1) AS topic, max(s) FILTER (r = 1) AS s, string_agg(name, ',' ORDER BY r) FILTER (r <= 3) AS topics FROM r GROUP BY 1)
SELECT lang, coalesce(topic, 'general') AS topic, coalesce(topics, 'general') AS topics, count(*) AS n_docs, round(avg(CASE WHEN s IS NULL THEN 0.3 ELSE least(s / 3.0, 0.95) END), 6) AS confidence
FROM documents LEFT JOIN p USING (doc_id) GROUP BY 1, 2, 3""",
)
def enr2(spark, sf_dir):
    out = en.topics(tables.load(spark, sf_dir, "documents"), CORPUS_TOPICS)
    return out.groupBy("lang", "topic", F.array_join("topics", ",").alias("topics")).agg(
        F.count("*").alias("n_docs"), F.round(F.avg("topic_confidence"), 6).alias("confidence"))


@query(
    "enr3_keywords",
    f"""
WITH w AS (SELECT doc_id, unnest(list_filter({sq.words_of('text')}, lambda x: regexp_full_match(x, '[a-z]{{4,}}') AND x NOT IN {sq.sql_list(en.KEYWORD_STOP_WORDS)})) AS word FROM documents),
f AS (SELECT doc_id, word, count(*) AS freq FROM w GROUP BY 1, 2),
s AS (SELECT f.doc_id, word, freq * CASE WHEN contains(left(lower(text), length(text) // 5), word) THEN 1.5 ELSE 1.0 END::DOUBLE AS score FROM f JOIN documents d ON d.doc_id = f.doc_id)
SELECT doc_id, word, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS rank FROM s QUALIFY rank <= 10""",
)
def enr3(spark, sf_dir):
    out = en.keywords(tables.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "word", "score", F.col("rank").cast("long").alias("rank"))


_MARKS = ", ".join(
    "{'s': len(list_intersect(list_distinct(ws), [" + ", ".join(f"'{m}'" for m in ms) + f"])), 'o': {-i}, 'l': '{lang}'" + "}"
    for i, (lang, ms) in enumerate(en.LANGUAGE_MARKERS.items()))


@query(
    "enr4_language_confusion",
    f"""
WITH w AS (SELECT lang, {sq.words_of('text')} AS ws FROM documents), b AS (SELECT lang, list_max([{_MARKS}]) AS b FROM w)
SELECT lang, CASE WHEN b.s > 0 THEN b.l ELSE 'unknown' END AS guess, count(*) AS n_docs FROM b GROUP BY 1, 2""",
)
def enr4(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("lang", en.guess_language(F.col("text")).alias("guess"))
    return docs.groupBy("lang", "guess").agg(F.count("*").alias("n_docs"))


@query(
    "enr5_reading_level",
    rf"""
WITH w AS (SELECT doc_id, lang, {sq.words_of('text')} AS ws,
  len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')) AS ns FROM documents),
s AS (SELECT *, list_sum(list_transform(ws, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS syl FROM w),
f AS (SELECT lang, CASE WHEN len(ws) > 0 AND ns > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * (len(ws) / ns) - 84.6::DOUBLE * (syl / len(ws)) END AS f FROM s)
SELECT lang, CASE WHEN f IS NULL THEN 'unknown' WHEN f >= 90 THEN 'elementary' WHEN f >= 70 THEN 'middle_school' WHEN f >= 50 THEN 'high_school' WHEN f >= 30 THEN 'college' ELSE 'graduate' END AS reading_level,
  count(*) AS n_docs, round(avg(f), 6) AS mean_flesch FROM f GROUP BY 1, 2""",
)
def enr5(spark, sf_dir):
    out = en.reading_level(tables.load(spark, sf_dir, "documents"))
    return out.groupBy("lang", "reading_level").agg(F.count("*").alias("n_docs"), F.round(F.avg("flesch"), 6).alias("mean_flesch"))


@query("enr6_summaries")
def enr6(spark, sf_dir):
    return en.summaries(tables.load(spark, sf_dir, "documents"))


def entity_sources(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    pages = tables.load(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000_000).alias("doc_id"), F.col("html").alias("text"))
    return docs.unionByName(pages)


_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS entity_type, unnest(regexp_extract_all(text, '(?i){pattern}')) AS entity_text FROM src" for kind, pattern in ent.PATTERNS.items())
ENTITIES = f"""
src AS (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + page_id, html FROM pages),
hits AS ({_HITS})"""


@query("ent1_entities", "WITH" + ENTITIES + " SELECT doc_id, entity_type, entity_text, count(*) AS n FROM hits GROUP BY 1, 2, 3")
def ent1(spark, sf_dir):
    return ent.extract(entity_sources(spark, sf_dir)).groupBy("doc_id", "entity_type", "entity_text").agg(F.count("*").alias("n"))


@query(
    "ent1_offsets",
    "WITH" + ENTITIES + " SELECT entity_type, count(*) AS n, CAST(sum(length(entity_text)) AS BIGINT) AS n_chars, count(*) AS n_at_offset FROM hits GROUP BY 1",
)
def ent1_offsets(spark, sf_dir):
    """Every reported offset must lead back to the entity text."""
    src = entity_sources(spark, sf_dir)
    found = ent.extract(src).join(src, "doc_id")
    there = F.substring(F.col("text"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")) == F.col("entity_text")
    return found.groupBy("entity_type").agg(
        F.count("*").alias("n"), F.sum(F.length("entity_text").cast("long")).alias("n_chars"), F.count_if(there).alias("n_at_offset"))


@query(
    "ent2_deduplicated",
    "WITH" + ENTITIES + r""",
k AS (SELECT *, lower(regexp_replace(entity_text, '^\s+|\s+$', '', 'g')) AS entity FROM hits)
SELECT entity, entity_type, min(doc_id) AS doc_id, count(*) AS n_mentions, 0.9::DOUBLE AS confidence FROM k GROUP BY 1, 2""",
)
def ent2(spark, sf_dir):
    return ent.deduplicate(ent.extract(entity_sources(spark, sf_dir))).drop("entity_text")


@query(
    "ent3_chunks_by_entity",
    sq.with_(sq.CHUNKS, sq.MENTIONS) + "SELECT DISTINCT chunk_id FROM mentions WHERE entity_type = 'concept' AND contains(lower(entity_text), 'tio')",
)
def ent3(spark, sf_dir):
    return ent.find_chunks(tables.concept_mentions(spark, sf_dir), "TIO", "concept")
