"""Graph queries: entity graphs from documents, triple graphs from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import store, tables
from docloom.functions import sizing
from docloom.functions import text as tx
from docloom.operators import graph as gr
from docloom.plans import fragments as sq
from docloom.plans.data import PROPERTY, exported_graph
from docloom.plans.evaluation import rounded
from docloom.plans.registry import query

MENTIONED = sq.with_(sq.CHUNKS, sq.MENTIONS) + """,
named AS (SELECT chunk_id, m.doc_id, CASE WHEN d.lang = 'en' THEN replace(entity_text, 'e', 'E') ELSE entity_text END AS entity_text, entity_type, confidence FROM mentions m JOIN documents d ON d.doc_id = m.doc_id),
ids AS (SELECT *, 'ent_' || substr(md5(lower(entity_text) || ':' || lower(entity_type)), 1, 12) AS id FROM named)"""


def mentioned(spark, sf_dir, languages=()):
    """Concept mentions; English documents write a capital E, so case variants exist.

    Documents meet the chunks before these are taken apart, as a chunk moves in fewer bytes than its
    mentions. ``languages`` names further columns, each with the language of a document of that id.
    """
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("_lang"))
    few = sizing.is_small(docs)
    rows = tables.chunks(spark, sf_dir).select("chunk_id", "doc_id", "content")
    for name in ("_lang", *languages):
        rows = rows.join(sizing.small_side(docs.withColumnRenamed("_lang", name), few), "doc_id")
    m = tables.mentions_in(rows)
    return m.withColumn("entity_text", F.when(F.col("_lang") == "en", F.replace("entity_text", F.lit("e"), F.lit("E"))).otherwise(F.col("entity_text"))).drop("_lang")


@query("grf1_entity_ids", MENTIONED + " SELECT id, count(*) AS n_mentions, count(DISTINCT entity_text) AS n_spellings, count(DISTINCT chunk_id) AS n_chunks FROM ids GROUP BY 1")
def grf1(spark, sf_dir):
    m = mentioned(spark, sf_dir).withColumn("id", gr.entity_id(F.col("entity_text"), F.col("entity_type")))
    return m.groupBy("id").agg(F.count("*").alias("n_mentions"), F.countDistinct("entity_text").alias("n_spellings"), F.countDistinct("chunk_id").alias("n_chunks"))


def built(spark, sf_dir):
    return gr.build(tables.chunks(spark, sf_dir).select("doc_id", "chunk_id"), mentioned(spark, sf_dir))


BUILT = MENTIONED + """,
nodes AS (SELECT DISTINCT 'doc_' || doc_id AS id, 'document' AS type FROM chunks UNION ALL SELECT 'chunk_' || chunk_id, 'chunk' FROM chunks UNION ALL SELECT DISTINCT id, entity_type FROM ids),
edges AS (SELECT 'chunk_' || chunk_id AS src, 'doc_' || doc_id AS dst, 'part_of' AS type FROM chunks UNION ALL SELECT DISTINCT id, 'chunk_' || chunk_id, 'appears_in' FROM ids)"""


@query("grf2_build_nodes", BUILT + " SELECT type, count(*) AS n, count(DISTINCT id) AS n_ids FROM nodes GROUP BY 1")
def grf2_nodes(spark, sf_dir):
    return built(spark, sf_dir)[0].groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("grf2_build_edges", BUILT + " SELECT * FROM edges")
def grf2_edges(spark, sf_dir):
    return built(spark, sf_dir)[1]


def incidence(spark, sf_dir):
    m = mentioned(spark, sf_dir).select(gr.entity_id(F.col("entity_text"), F.col("entity_type")).alias("node_id"), "chunk_id").distinct()
    own = tables.chunks(spark, sf_dir).select(F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string")).alias("node_id"), "chunk_id")
    return m.unionByName(own)


def asked_entities(spark, sf_dir):
    """Entities named by the benchmark items: the query side of graph retrieval."""
    items = tables.load(spark, sf_dir, "benchmark")
    return items.select("item_id", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("w")).select(
        F.col("item_id").alias("query_id"), gr.entity_id(F.col("w"), F.lit("concept")).alias("node_id"))


ASKED = f"""
asked AS (SELECT DISTINCT 'ent_' || substr(md5(w || ':concept'), 1, 12) AS node_id FROM (SELECT unnest({sq.words_of('text')}) AS w FROM benchmark))"""


@query(
    "grf3_cooccurrence",
    MENTIONED + "," + ASKED + """,
inc AS (SELECT DISTINCT id AS node_id, chunk_id FROM ids UNION ALL SELECT 'chunk_' || chunk_id, chunk_id FROM chunks)
SELECT a.node_id AS seed_id, b.node_id, min(a.chunk_id) AS first_chunk, count(*) AS n_chunks FROM inc a JOIN inc b ON a.chunk_id = b.chunk_id AND a.node_id <> b.node_id
WHERE a.node_id IN (SELECT node_id FROM asked) GROUP BY 1, 2""",
)
def grf3(spark, sf_dir):
    return gr.cooccurring(incidence(spark, sf_dir), asked_entities(spark, sf_dir))


MERGED = MENTIONED + """,
gn AS (SELECT CASE WHEN lang = 'en' THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END AS graph, lang || ':' || i.entity_text AS id, i.entity_text AS name, entity_type AS type, max(0.5 + 0.1 * CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END) AS confidence, lang
  FROM ids i JOIN documents d ON d.doc_id = i.doc_id GROUP BY ALL),
pr AS (SELECT lower(name) AS key, type, k, arg_max(v, (graph, id)) AS v FROM (SELECT *, unnest(['lang', 'from_' || lang]) AS k, unnest([lang, name]) AS v FROM gn) GROUP BY 1, 2, 3),
pm AS (SELECT key, type, string_agg(k || '=' || v, ';' ORDER BY k) AS properties FROM pr GROUP BY 1, 2),
mn AS (SELECT lower(name) AS key, type, arg_min(id, (graph, id)) AS id, max(confidence)::DOUBLE AS confidence, count(*) AS n_merged FROM gn GROUP BY 1, 2),
im AS (SELECT DISTINCT g.id, m.id AS new_id FROM gn g JOIN mn m ON lower(g.name) = m.key AND g.type = m.type)"""


def labelled_graphs(spark, sf_dir):
    """One graph per language group: nodes, chunk incidence and appears_in edges with own ids; the merge makes the last two distinct."""
    m = mentioned(spark, sf_dir, ["lang"]).withColumn("id", F.concat("lang", F.lit(":"), "entity_text"))
    number = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).otherwise(3)
    nodes = m.select(number.alias("graph"), "id", F.col("entity_text").alias("name"), F.col("entity_type").alias("type"),
                     F.round(0.5 + 0.1 * number, 1).alias("confidence"), "lang").distinct()
    nodes = nodes.withColumn("properties", F.create_map(F.lit("lang"), F.col("lang"), F.concat(F.lit("from_"), F.col("lang")), F.col("name"))).drop("lang")
    chunk = F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string"))
    edges = m.select(F.col("id").alias("src"), chunk.alias("dst"), F.lit("appears_in").alias("type"))
    return nodes, m.select("id", "chunk_id"), edges


@query("grf4_merged_nodes", MERGED + " SELECT id, mn.type, round(confidence, 1) AS confidence, properties, n_merged FROM mn JOIN pm ON pm.key = mn.key AND pm.type = mn.type")
def grf4_nodes(spark, sf_dir):
    merged = gr.merge(*labelled_graphs(spark, sf_dir))[0].drop("name")
    listed = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.withColumn("properties", F.array_join(listed, ";"))


@query(
    "grf4_merged_edges",
    MERGED + " SELECT DISTINCT im.new_id AS src, 'chunk_' || i.chunk_id AS dst, 'appears_in' AS type FROM ids i JOIN documents d ON d.doc_id = i.doc_id JOIN im ON im.id = d.lang || ':' || i.entity_text",
)
def grf4_edges(spark, sf_dir):
    return gr.merge(*labelled_graphs(spark, sf_dir))[2]


@query(
    "grf5_neighbours",
    BUILT + "," + ASKED + """,
e2 AS (SELECT src, dst FROM edges WHERE type = 'appears_in' UNION SELECT dst, src FROM edges WHERE type = 'appears_in')
SELECT e2.src AS seed_id, n.id, n.type FROM e2 JOIN nodes n ON n.id = e2.dst WHERE e2.src IN (SELECT node_id FROM asked)""",
)
def grf5(spark, sf_dir):
    nodes, edges = built(spark, sf_dir)
    seeds = asked_entities(spark, sf_dir).select(F.col("node_id").alias("id"))
    return gr.neighbours(edges, seeds, nodes.select("id", "type"), "appears_in").select("seed_id", "id", "type")


@query(
    "grf6_induced_subgraph",
    BUILT + "," + ASKED + """,
keep AS (SELECT node_id AS id FROM asked UNION SELECT id FROM nodes WHERE type IN ('chunk', 'document'))
SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)""",
)
def grf6(spark, sf_dir):
    chunks, m, kinds = tables.chunks(spark, sf_dir).select("doc_id", "chunk_id"), mentioned(spark, sf_dir), ["chunk", "document"]
    edges = gr.build(chunks, m)[1]
    nodes = gr.build(chunks, m.where(F.lower("entity_type").isin(kinds)))[0]  # mentions of other types make no node that is kept
    ids = asked_entities(spark, sf_dir).select(F.col("node_id").alias("id")).unionByName(nodes.where(F.col("type").isin(kinds)).select("id"))
    return gr.induced(edges, ids)


@query(
    "grf7_statistics",
    BUILT + """ SELECT 'node' AS kind, type, count(*)::DOUBLE AS value FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*)::DOUBLE FROM edges GROUP BY 2
UNION ALL SELECT 'graph', 'density', round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 4)""",
)
def grf7(spark, sf_dir):
    return gr.statistics(*built(spark, sf_dir))


TRIPLES = """
raw AS (SELECT 'C' || o_custkey AS subject, 'ordered' AS predicate, 'P' || l_partkey AS object, o_orderkey AS passage_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'S' || l_suppkey, 'supplies', 'P' || l_partkey, l_orderkey FROM lineitem),
tr AS (SELECT DISTINCT subject, predicate, object FROM raw),
links AS (SELECT DISTINCT entity, passage_id FROM (SELECT subject AS entity, passage_id FROM raw UNION ALL SELECT object, passage_id FROM raw))"""


#: Stored bytes of order lines that one task joins and makes triples of; a line becomes four links.
LINE_BYTES = 8 << 20


def raw_triples(spark, sf_dir):
    """Triples of customers, suppliers and parts by order; a large table is dealt by order over more tasks, not larger ones."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lines = tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = store.state_of(spark, f"{sf_dir}/lineitem.parquet")[1] // LINE_BYTES
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines, orders = (t.repartition(parts, "l_orderkey") for t in (lines, orders))
    both = lines.join(orders, "l_orderkey")
    part = name("P", "l_partkey")
    rows = F.array(
        F.struct(name("C", "o_custkey").alias("subject"), F.lit("ordered").alias("predicate"), part.alias("object")),
        F.struct(name("S", "l_suppkey").alias("subject"), F.lit("supplies").alias("predicate"), part.alias("object")))
    return both.select(F.explode(rows).alias("t"), F.col("l_orderkey").alias("passage_id")).select("t.*", "passage_id")


def simple_edges(spark, sf_dir):
    triples = gr.load_triples(raw_triples(spark, sf_dir))[0]
    return triples.select(F.col("subject").alias("src"), F.col("object").alias("dst"))


_ROUNDS = 4
_LP = "adj AS (SELECT DISTINCT subject AS src, object AS dst FROM tr UNION SELECT object, subject FROM tr), l0 AS (SELECT DISTINCT src AS id, src AS label FROM adj)" + "".join(
    f""",
v{i} AS (SELECT src, l.label, count(*) AS n, any_value(o.label) AS own FROM adj JOIN l{i - 1} l ON dst = l.id JOIN l{i - 1} o ON o.id = src GROUP BY 1, 2),
l{i} AS (SELECT src AS id, CASE WHEN ascii(md5(src || ':{i}')) % 2 = 0 THEN arg_min(label, (-n, label <> own, label)) ELSE any_value(own) END AS label FROM v{i} GROUP BY src)""" for i in range(1, _ROUNDS + 1))
PROPAGATED = "WITH" + TRIPLES + ", " + _LP


@query("grf8_label_propagation", PROPAGATED + f" SELECT id, label FROM l{_ROUNDS}")
def grf8(spark, sf_dir):
    """Four rounds, which SQL can unroll."""
    return gr.label_propagation(simple_edges(spark, sf_dir), _ROUNDS, stop_when_stable=False)


@query("grf8_converged")
def grf8_converged(spark, sf_dir):
    """The same until no node moves; a warning says so if the limit of rounds ends it before."""
    return gr.label_propagation(simple_edges(spark, sf_dir))


@query("grf9_modularity_communities")
def grf9(spark, sf_dir):
    """The whole graph, merged until no pair gains."""
    return gr.greedy_modularity(simple_edges(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("size"))


GROUPED = "WITH" + TRIPLES + """,
adj AS (SELECT DISTINCT subject AS src, object AS dst FROM tr UNION SELECT object, subject FROM tr),
lb AS (SELECT 'C' || c_custkey AS id, c_nationkey AS label, 'customer' AS type FROM customer UNION ALL SELECT 'S' || s_suppkey, s_nationkey, 'supplier' FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_size % 25, 'part' FROM part)"""


def grouped(spark, sf_dir):
    """A given labelling to score: nation of customers and suppliers, size class of parts."""
    part = lambda table, prefix, key, label, kind: tables.load(spark, sf_dir, table).select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), label.alias("label"), F.lit(kind).alias("type"))
    return (
        part("customer", "C", "c_custkey", F.col("c_nationkey"), "customer")
        .unionByName(part("supplier", "S", "s_suppkey", F.col("s_nationkey"), "supplier"))
        .unionByName(part("part", "P", "p_partkey", F.col("p_size") % 25, "part")))


@query(
    "grf10_modularity",
    GROUPED + """,
d AS (SELECT src, count(*) AS d FROM adj GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS two_m FROM adj),
s AS (SELECT count(*)::DOUBLE AS inside, sum((da.d * db.d)::DOUBLE) AS prod FROM adj JOIN lb a ON a.id = adj.src JOIN lb b ON b.id = adj.dst JOIN d da ON da.src = adj.src JOIN d db ON db.src = adj.dst WHERE a.label = b.label),
k AS (SELECT sum(k * k) AS k2 FROM (SELECT sum(d)::DOUBLE AS k FROM lb JOIN d ON d.src = id GROUP BY label))
SELECT round((inside - prod / two_m) / two_m, 9) AS edge_only, round(inside / two_m - k2 / (two_m * two_m), 9) AS standard FROM s, k, t""",
)
def grf10(spark, sf_dir):
    return rounded(gr.modularity(simple_edges(spark, sf_dir), grouped(spark, sf_dir).select("id", "label")), "edge_only", "standard", digits=9)


@query(
    "grf11_community_table",
    GROUPED + """,
dg AS (SELECT adj.src AS id, count(*) AS degree FROM adj JOIN lb a ON a.id = adj.src JOIN lb b ON b.id = adj.dst WHERE a.label = b.label GROUP BY 1),
mb AS (SELECT lb.*, coalesce(degree, 0) AS degree FROM lb LEFT JOIN dg USING (id)),
ty AS (SELECT label, type, count(*) AS n FROM mb GROUP BY 1, 2),
sz AS (SELECT label, CAST(sum(n) AS BIGINT) AS size, arg_min(type, (-n, type)) AS main_type FROM ty GROUP BY 1 HAVING sum(n) >= 3 ORDER BY size DESC, label LIMIT 20),
tp AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY degree DESC, id) AS r FROM mb QUALIFY r <= 5)
SELECT CAST(label AS INTEGER) AS label, size, main_type, string_agg(id, ',' ORDER BY r) AS key_members FROM sz JOIN tp USING (label) GROUP BY 1, 2, 3""",
)
def grf11(spark, sf_dir):
    labels = grouped(spark, sf_dir)
    return gr.community_table(simple_edges(spark, sf_dir), labels.select("id", "label"), labels.select("id", "type"), 3, 20)


@query(
    "grf11_coverage",
    GROUPED + " SELECT round(count(*) FILTER (a.label = b.label) / (SELECT count(*) FROM adj), 9) AS coverage FROM adj JOIN lb a ON a.id = adj.src JOIN lb b ON b.id = adj.dst",
)
def grf11_coverage(spark, sf_dir):
    return rounded(gr.coverage(simple_edges(spark, sf_dir), grouped(spark, sf_dir).select("id", "label")), "coverage", digits=9)


@query(
    "grf11_detection_summary",
    GROUPED + """,
al AS (SELECT 'C' || c_custkey AS id FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier UNION ALL SELECT 'P' || p_partkey FROM part UNION ALL SELECT 'N' || n_nationkey FROM nation),
lb2 AS (SELECT * FROM lb WHERE id IN (SELECT src FROM adj)),
d AS (SELECT src, count(*) AS d FROM adj GROUP BY 1), t AS (SELECT sum(d)::DOUBLE AS two_m FROM d),
s AS (SELECT count(*)::DOUBLE AS inside, sum((da.d * db.d)::DOUBLE) AS prod FROM adj JOIN lb2 a ON a.id = adj.src JOIN lb2 b ON b.id = adj.dst JOIN d da ON da.src = adj.src JOIN d db ON db.src = adj.dst WHERE a.label = b.label),
k AS (SELECT sum(k * k) AS k2 FROM (SELECT sum(d)::DOUBLE AS k FROM lb2 JOIN d ON d.src = id GROUP BY label))
SELECT (SELECT count(DISTINCT label) FROM lb2) AS communities, (SELECT count(*) FROM lb2) AS assigned, round((SELECT count(*) FROM lb2) / (SELECT count(*) FROM al), 9) AS coverage,
  round((inside - prod / two_m) / two_m, 9) AS edge_only, round(inside / two_m - k2 / (two_m * two_m), 9) AS standard FROM s, k, t""",
)
def grf11_summary(spark, sf_dir):
    """Nodes with an edge have a community; nations are nodes without any."""
    edges, labels = simple_edges(spark, sf_dir), grouped(spark, sf_dir)
    connected = labels.join(gr.both_ways(edges).select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", "label")
    nations = tables.load(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"))
    return rounded(gr.detection_summary(edges, connected, labels.select("id").unionByName(nations)), "coverage", "edge_only", "standard", digits=9)


@query("grf12_multi_level")
def grf12(spark, sf_dir):
    return gr.multi_level(simple_edges(spark, sf_dir), 2).groupBy("level", "label").agg(F.count("*").alias("size"))


@query("grf13_triples", "WITH" + TRIPLES + " SELECT subject, predicate, object FROM tr")
def grf13(spark, sf_dir):
    return gr.load_triples(raw_triples(spark, sf_dir))[0]


@query("grf13_entity_passages", "WITH" + TRIPLES + " SELECT entity, count(*) AS n_passages, min(passage_id) AS first_passage, max(passage_id) AS last_passage FROM links GROUP BY 1")
def grf13_links(spark, sf_dir):
    return gr.load_triples(raw_triples(spark, sf_dir))[1].groupBy("entity").agg(
        F.count("*").alias("n_passages"), F.min("passage_id").alias("first_passage"), F.max("passage_id").alias("last_passage"))


_PR = 6
RANKED = "WITH" + TRIPLES + """,
ed AS (SELECT subject AS src, object AS dst FROM tr UNION ALL SELECT object, subject FROM tr),
dg AS (SELECT src, count(*) AS deg FROM ed GROUP BY 1),
wk AS (SELECT ed.src, dst, count(*) / any_value(deg) AS p FROM ed JOIN dg ON dg.src = ed.src GROUP BY 1, 2),
sd AS (SELECT c_nationkey AS query_id, 'C' || c_custkey AS entity FROM customer),
ks AS (SELECT query_id, count(*) AS k FROM sd GROUP BY 1),
jp AS (SELECT query_id, entity AS node, 0.15::DOUBLE / k AS score FROM sd JOIN ks USING (query_id) WHERE entity IN (SELECT src FROM dg)),
p1 AS (SELECT * FROM jp)""" + "".join(f""",
p{i} AS (SELECT query_id, node, sum(score) AS score FROM (SELECT query_id, dst AS node, 0.85::DOUBLE * score * p AS score FROM p{i - 1} JOIN wk ON node = src UNION ALL SELECT * FROM jp) GROUP BY 1, 2)""" for i in range(2, _PR + 1))


def nation_seeds(spark, sf_dir):
    """One graph query per nation: its customers are the seeds."""
    return tables.load(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("query_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity"))


def pagerank(spark, sf_dir):
    triples, links = gr.load_triples(raw_triples(spark, sf_dir))
    return gr.personalised_pagerank(triples, nation_seeds(spark, sf_dir), _PR, tolerance=None), links


@query("grf14_pagerank", RANKED + f" SELECT CAST(query_id AS INTEGER) AS query_id, node, round(score, 9) AS score FROM p{_PR}")
def grf14(spark, sf_dir):
    return rounded(pagerank(spark, sf_dir)[0], "score", digits=9)


def converged_pagerank(spark, sf_dir):
    triples, links = gr.load_triples(raw_triples(spark, sf_dir))
    return gr.personalised_pagerank(triples, nation_seeds(spark, sf_dir)), links


# Rounds until no score moves, as a recursion whose step sees the round before it; the last round is the answer.
CONVERGED = RANKED[:RANKED.index(",\np1 AS")].replace("WITH", "WITH RECURSIVE", 1) + """,
it(i, query_id, node, score, moved) AS (
  SELECT 1, query_id, node, score, 1.0::DOUBLE FROM jp
  UNION ALL
  SELECT any_value(i), query_id, node, sum(score), max(abs(sum(score) - sum(old))) OVER () FROM (
    SELECT i + 1 AS i, query_id, dst AS node, 0.85::DOUBLE * score * p AS score, 0.0::DOUBLE AS old FROM it JOIN wk ON node = src WHERE moved >= 1e-6
    UNION ALL SELECT i + 1, query_id, node, 0.0, score FROM it WHERE moved >= 1e-6
    UNION ALL SELECT n.i + 1, jp.query_id, jp.node, jp.score, 0.0 FROM jp, (SELECT max(i) AS i FROM it WHERE moved >= 1e-6) n WHERE n.i IS NOT NULL)
  WHERE i <= 50 GROUP BY query_id, node),
pc AS (SELECT query_id, node, score FROM it WHERE i = (SELECT max(i) FROM it))"""


@query("grf14_converged", CONVERGED + " SELECT CAST(query_id AS INTEGER) AS query_id, node, round(score, 9) AS score FROM pc")
def grf14_converged(spark, sf_dir):
    """Personalised PageRank until no score moves."""
    return rounded(converged_pagerank(spark, sf_dir)[0], "score", digits=9)


def passages_sql(scores: str) -> str:
    return f""",
ps AS (SELECT query_id, passage_id, round(sum(score), 12) AS score FROM links JOIN {scores} ON entity = node GROUP BY 1, 2),
top AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM ps QUALIFY rank <= 10
  UNION ALL SELECT 1000, o_orderkey, 1.0, row_number() OVER (ORDER BY o_orderkey DESC) FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) <= 10)"""


PASSAGES, CONVERGED_PASSAGES = RANKED + passages_sql(f"p{_PR}"), CONVERGED + passages_sql("pc")
TOP_PASSAGES = " SELECT CAST(query_id AS INTEGER) AS query_id, passage_id, score, rank FROM top"
LISTED = """,
en AS (SELECT DISTINCT query_id, entity FROM (SELECT query_id, entity FROM top JOIN links USING (passage_id) UNION ALL SELECT query_id, entity FROM sd)),
rk AS (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY entity) AS r FROM en QUALIFY r <= 20),
cf AS (SELECT query_id, round(avg(score), 9) AS confidence FROM top GROUP BY 1)
SELECT CAST(query_id AS INTEGER) AS query_id, string_agg(entity, ',' ORDER BY r) AS entities, any_value(confidence) AS confidence FROM rk JOIN cf USING (query_id) GROUP BY 1"""

def ranked_passages(spark, sf_dir, converged=False):
    scores, links = (converged_pagerank if converged else pagerank)(spark, sf_dir)
    asked = nation_seeds(spark, sf_dir).select("query_id").distinct().withColumn("has_seeds", F.lit(True))
    asked = asked.unionByName(spark.createDataFrame([(1000, False)], "query_id int, has_seeds boolean"))
    passages = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("passage_id"))
    return gr.rank_passages(scores, links, passages, asked), links


@query("grf15_passages", PASSAGES + TOP_PASSAGES)
def grf15(spark, sf_dir):
    return ranked_passages(spark, sf_dir)[0].withColumn("rank", F.col("rank").cast("long"))


@query("grf15_converged", CONVERGED_PASSAGES + TOP_PASSAGES)
def grf15_converged(spark, sf_dir):
    """The same from converged PageRank."""
    return ranked_passages(spark, sf_dir, converged=True)[0].withColumn("rank", F.col("rank").cast("long"))


@query("grf16_result_entities", PASSAGES + LISTED)
def grf16(spark, sf_dir):
    return listed_entities(spark, sf_dir, *ranked_passages(spark, sf_dir))


@query("grf16_converged", CONVERGED_PASSAGES + LISTED)
def grf16_converged(spark, sf_dir):
    """The same from converged PageRank."""
    return listed_entities(spark, sf_dir, *ranked_passages(spark, sf_dir, converged=True))


def listed_entities(spark, sf_dir, results, links):
    entities = gr.result_entities(results, links, nation_seeds(spark, sf_dir))
    sure = results.groupBy("query_id").agg(F.round(F.avg("score"), 9).alias("confidence"))
    listed = entities.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda x: x["entity"]), ",").alias("entities"))
    return listed.join(sure, "query_id")


@query(
    "grf16_related_triples",
    "WITH" + TRIPLES + """,
big AS (SELECT 'S' || s_suppkey AS entity FROM supplier WHERE s_acctbal > 9000 UNION SELECT 'C' || c_custkey FROM customer WHERE c_acctbal > 9900)
SELECT subject, predicate, object FROM tr WHERE subject IN (SELECT entity FROM big) OR object IN (SELECT entity FROM big)""",
)
def grf16_triples(spark, sf_dir):
    rich = tables.load(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 9000).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity"))
    rich = rich.unionByName(tables.load(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9900).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity")))
    return gr.related_triples(gr.load_triples(raw_triples(spark, sf_dir))[0], rich)


@query(
    "txt7_graph_search",
    PROPERTY + """,
ch AS (SELECT doc_id || '_chunk_' || chunk_index AS id, content, source, lang, chunk_index FROM chunks),
a AS (SELECT 'content' AS kind, id, NULL AS entity FROM ch WHERE contains(content, 'tion') ORDER BY id LIMIT 10),
b AS (SELECT 'entity' AS kind, id, source AS entity FROM ch WHERE contains(source, 'src1') AND chunk_index < 3 ORDER BY id, entity LIMIT 10),
c AS (SELECT 'document' AS kind, doc_id::VARCHAR AS id, NULL AS entity FROM documents WHERE source = 'src1' AND lang = 'fr' ORDER BY id LIMIT 10)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def txt7(spark, sf_dir):
    nodes, edges = exported_graph(spark, sf_dir)
    by_text = gr.search(nodes, edges, "tion", "content", 10).withColumn("kind", F.lit("content"))
    by_name = gr.search(nodes, edges, "src1", "entity", 10).withColumn("kind", F.lit("entity"))
    by_metadata = gr.search(nodes, edges, '"title":"src1","author":"fr"', "document", 10).withColumn("kind", F.lit("document"))
    return by_text.unionByName(by_name).unionByName(by_metadata)
