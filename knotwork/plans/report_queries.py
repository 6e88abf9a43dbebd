"""Queries on reports, corrections, accesses and the parsers' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import access as A
from knotwork.operators import corrections as C
from knotwork.operators import reflect as S
from knotwork.operators import render as N
from knotwork.operators import reports as H
from knotwork.operators.spread import numbered
from knotwork.plans.registry import AS_OF, DIRECTED, NODES, UNDIRECTED, SQL, directed, graph_nodes, query, undirected
from knotwork.plans.text_queries import CONTENT
from knotwork.session import materialise, table

#: What topic queries look for. Fixed value.
TOPIC = "Archive"
ENDS_SQL = "SELECT graph_id, unnest([from_node, to_node]) AS node_id FROM d UNION ALL SELECT graph_id, unnest([node_a, node_b]) FROM u"
PLAIN_EDGE = "graph_id", "from_node", "to_node", "edge_type", "weight"
PAIR_EDGE = "graph_id", "node_a", "node_b", "edge_type", "weight"


@query(
    f"""WITH {NODES}, {DIRECTED}, {UNDIRECTED} SELECT graph_id, 'node' AS kind, node_type AS type, count(*) AS n FROM n GROUP BY ALL
UNION ALL SELECT graph_id, 'directed', edge_type, count(*) FROM d GROUP BY ALL UNION ALL SELECT graph_id, 'undirected', edge_type, count(*) FROM u GROUP BY ALL"""
)
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return H.graph_stats(graph_nodes(spark, sf, "graph_id", "node_id", "node_type"), directed(spark, sf, *PLAIN_EDGE), undirected(spark, sf, *PAIR_EDGE))


@query(
    f"""WITH {NODES}, {DIRECTED}, {UNDIRECTED}, l AS (SELECT DISTINCT graph_id, node_id, true AS linked FROM ({ENDS_SQL}) WHERE node_id IS NOT NULL),
h AS (SELECT graph_id, count(*) AS n_nodes, count(*) FILTER (linked IS NULL) AS n_orphans, count(*) FILTER (confidence < 0.5) AS n_weak, count(*) FILTER (valid_until < TIMESTAMP '{AS_OF}') AS n_expired,
 count(*) FILTER (metadata['synthesis'] IS NOT NULL) AS n_enriched, count(*) FILTER (metadata['synthesis'] IS NULL AND node_type NOT IN ('document', 'section')) AS n_unenriched,
 floor(avg(confidence) * 1000000 + 0.500001) / 1000000 AS mean_confidence, floor(avg(access_count) * 1000000 + 0.500001) / 1000000 AS mean_accesses FROM n LEFT JOIN l USING (graph_id, node_id) GROUP BY 1)
SELECT h.*, coalesce(a.k, 0) AS n_directed, coalesce(b.k, 0) AS n_undirected FROM h LEFT JOIN (SELECT graph_id, count(*) AS k FROM d GROUP BY 1) a USING (graph_id) LEFT JOIN (SELECT graph_id, count(*) AS k FROM u GROUP BY 1) b USING (graph_id)"""
)
def graph_health(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "metadata", "confidence", "access_count", "valid_until")
    return H.graph_health(nodes, directed(spark, sf, *PLAIN_EDGE), undirected(spark, sf, *PAIR_EDGE), AS_OF)


COUNTED_SQL = "c AS (SELECT graph_id, entity, count(*) AS n FROM (SELECT graph_id, unnest(list_distinct(entities)) AS entity FROM {0}) GROUP BY 1, 2)"


@query(f"WITH {NODES}, {COUNTED_SQL.format('n')} SELECT graph_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY entity) AS k FROM c WHERE n = 1) WHERE k <= 20")
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return H.coverage_gaps(graph_nodes(spark, sf, "graph_id", "node_id", "entities"))


@query(f"WITH {NODES}, {CONTENT}, {COUNTED_SQL.format('t')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, entity) AS place FROM c) WHERE place <= 50")
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return H.topics(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "entities"))


REPORT_SQL = f"""{NODES}, {CONTENT}, e AS (SELECT *, unnest(list_distinct(entities)) AS name FROM t),
r AS (SELECT graph_id, name, count(*) AS fact_count, count(DISTINCT source.file) AS n_sources, min(created_at) AS first_ingested, max(last_accessed_at) AS last_accessed, sum(access_count)::BIGINT AS access_count,
 CASE WHEN round(avg(confidence), 9) > 0.8 THEN 'stable' WHEN round(avg(confidence), 9) > 0.5 THEN 'rising' ELSE 'decaying' END AS confidence_trend FROM e GROUP BY 1, 2 HAVING count(*) >= 3),
rep AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY fact_count DESC, name) AS k FROM r) WHERE k <= 100)"""
REPORTED = "graph_id", "node_id", "node_type", "ord", "source", "entities", "created_at", "last_accessed_at", "access_count", "confidence", "content"


@query(f"WITH {REPORT_SQL} SELECT * FROM rep")
def entity_report(spark: SparkSession, sf: str) -> DataFrame:
    return H.entity_reports(graph_nodes(spark, sf, *REPORTED))


@query(
    f"""WITH {REPORT_SQL}, {DIRECTED}, f AS (SELECT * FROM (SELECT e.graph_id, e.name, e.node_id, row_number() OVER (PARTITION BY e.graph_id, e.name ORDER BY ord, e.node_id) AS k FROM e JOIN rep ON rep.graph_id = e.graph_id AND rep.name = e.name) WHERE k <= 5),
o AS (SELECT f.graph_id, name, left(t.content, 80) AS target, edge_type, weight, row_number() OVER (PARTITION BY f.graph_id, name ORDER BY k, edge_id) AS r FROM f JOIN d ON d.graph_id = f.graph_id AND d.from_node = f.node_id JOIN t ON t.graph_id = d.graph_id AND t.node_id = d.to_node)
SELECT graph_id, name, target, edge_type, weight FROM o WHERE r <= 10"""
)
def entity_relationships(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, *REPORTED)
    return H.entity_relationships(nodes, directed(spark, sf, *PLAIN_EDGE), H.entity_reports(nodes))


@query(
    f"""WITH {REPORT_SQL} SELECT graph_id, name, fact_no, content, node_type, file FROM (SELECT e.graph_id, e.name, left(content, 300) AS content, node_type, source.file AS file,
  row_number() OVER (PARTITION BY e.graph_id, e.name ORDER BY ord, node_id) AS fact_no FROM e SEMI JOIN rep ON rep.graph_id = e.graph_id AND rep.name = e.name) WHERE fact_no <= 20"""
)
def entity_facts(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, *REPORTED)
    return H.entity_facts(nodes, H.entity_reports(nodes))


@query()
def audit_text(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, *REPORTED)
    entities = materialise(H.entity_reports(nodes), "entities")
    pairs = undirected(spark, sf, "graph_id", "node_a", "node_b")
    return N.audit_texts(graph_health(spark, sf), entities, coverage_gaps(spark, sf), H.entity_facts(nodes, entities), S.contradictions(nodes), S.discoveries(nodes, pairs), nodes)


INDEX_SQL = f"""{NODES}, k AS (SELECT graph_id, entity AS topic, count(*) AS n FROM (SELECT graph_id, unnest(list_distinct(entities)) AS entity FROM n) GROUP BY 1, 2),
f AS (SELECT graph_id, topic, n, 0 AS o FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, topic) AS r FROM k) WHERE r <= 30),
ps AS (SELECT graph_id, topic, coalesce(n, 0) AS n, 1 AS o FROM (SELECT DISTINCT graph_id, content AS topic FROM n WHERE node_type = 'person' AND content IS NOT NULL) ANTI JOIN f USING (graph_id, topic) LEFT JOIN k USING (graph_id, topic)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY o, n DESC, topic) AS r FROM (SELECT * FROM f UNION ALL SELECT * FROM ps)) WHERE r <= 40)"""


@query(
    f"""WITH {INDEX_SQL} SELECT graph_id, '# Topics of ' || graph_id || chr(10) || chr(10) || '## Pages (' || count(*) || ')' || chr(10) || chr(10) ||
 string_agg('- [' || topic || '](' || regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g') || '.md), ' || n || ' nodes', chr(10) ORDER BY r) AS text FROM l GROUP BY 1"""
)
def topic_index(spark: SparkSession, sf: str) -> DataFrame:
    return N.index_pages(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content", "entities"))


PAGE_SQL = f"""{NODES}, {CONTENT}, g AS (SELECT graph_id, node_id, node_type, content, confidence, coalesce(len(list_filter(entities, lambda q: contains(lower(q), '{TOPIC.lower()}'))) > 0, false) AS named, coalesce(contains(lower(content), '{TOPIC.lower()}'), false) AS said, metadata['synthesis'] IS NOT NULL AS rich FROM t),
h AS (SELECT graph_id, node_id, node_type, round((CASE WHEN named THEN 0.5 ELSE 0 END + CASE WHEN said THEN 0.3 ELSE 0 END + CASE WHEN said AND node_type = 'person' THEN 0.8 ELSE 0 END + CASE WHEN rich THEN 0.1 ELSE 0 END)::DOUBLE * confidence, 6) AS relevance,
 try_cast(regexp_extract(content, '\\b(1[0-9]{{3}}|20[0-2][0-9])\\b', 1) AS INT) AS year FROM g),
page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY relevance DESC, node_id) AS place FROM h WHERE relevance > 0) WHERE place <= 50)"""
PAGED = "graph_id", "node_id", "node_type", "content", "entities", "metadata", "confidence"


@query(f"WITH {PAGE_SQL} SELECT * FROM page")
def topic_page_rank(spark: SparkSession, sf: str) -> DataFrame:
    return H.topic_page(graph_nodes(spark, sf, *PAGED), TOPIC)


@query(
    f"""WITH {PAGE_SQL}, {DIRECTED}, e AS (SELECT d.* FROM d WHERE edge_type NOT IN ('contains', 'precedes') AND (EXISTS (SELECT 1 FROM page p WHERE p.graph_id = d.graph_id AND p.node_id = from_node) OR EXISTS (SELECT 1 FROM page p WHERE p.graph_id = d.graph_id AND p.node_id = to_node)))
SELECT e.graph_id, edge_id, edge_type, e.weight, left(a.content, 60) AS from_label, left(b.content, 60) AS to_label FROM e JOIN n a ON a.graph_id = e.graph_id AND a.node_id = from_node JOIN n b ON b.graph_id = e.graph_id AND b.node_id = to_node"""
)
def topic_relations(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, *PAGED)
    return H.topic_relations(H.topic_page(nodes, TOPIC), directed(spark, sf, *PLAIN_EDGE), nodes)


@query()
def topic_page_text(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, *PAGED, "source")
    page = materialise(H.topic_page(nodes, TOPIC), "page")
    return N.topic_pages(page, nodes, H.topic_relations(page, directed(spark, sf, *PLAIN_EDGE), nodes), TOPIC)


DEGREE_SQL = f"deg AS (SELECT graph_id, node_id, count(*) AS degree FROM ({ENDS_SQL}) WHERE node_id IS NOT NULL GROUP BY 1, 2)"
CANDIDATE_SQL = f"""cand AS (SELECT * FROM (SELECT graph_id, node_id, priority, row_number() OVER (PARTITION BY graph_id ORDER BY priority DESC, node_id) AS place FROM (
 SELECT graph_id, node_id, round(confidence * (1 + access_count * 0.1::DOUBLE) * (1 + coalesce(degree, 0) * 0.05::DOUBLE), 6) AS priority FROM t LEFT JOIN deg USING (graph_id, node_id) WHERE metadata['synthesis'] IS NULL AND length(content) >= 30)) WHERE place <= 20)"""


@query(f"WITH {DIRECTED}, {UNDIRECTED}, {DEGREE_SQL} SELECT * FROM deg")
def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return H.degrees(directed(spark, sf, *PLAIN_EDGE), undirected(spark, sf, *PAIR_EDGE))


@query(
    f"""WITH {NODES}, {DIRECTED}, {UNDIRECTED}, {DEGREE_SQL} SELECT graph_id, node_id, node_type, left(content, 60) AS label, coalesce(degree, 0) AS degree
FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY ord, node_id) AS k FROM n) LEFT JOIN deg USING (graph_id, node_id) WHERE k <= 10"""
)
def export_sample(spark: SparkSession, sf: str) -> DataFrame:
    return H.export_sample(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "content"), node_degrees(spark, sf))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return H.enrichment_candidates(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content", "metadata", "confidence", "access_count"), node_degrees(spark, sf))


@query(f"WITH {NODES}, {CONTENT}, {DIRECTED}, {UNDIRECTED}, {DEGREE_SQL}, {CANDIDATE_SQL} SELECT * FROM cand")
def enrichment_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf)


@query(
    f"""WITH {NODES}, {CONTENT}, {DIRECTED}, {UNDIRECTED}, {DEGREE_SQL}, {CANDIDATE_SQL},
w AS (SELECT graph_id, from_node AS node_id, to_node AS other, edge_type, 'out' AS direction, weight, edge_id FROM d UNION ALL SELECT graph_id, to_node, from_node, edge_type, 'in', weight, edge_id FROM d
 UNION ALL SELECT graph_id, node_a, node_b, edge_type, 'both', weight, edge_id FROM u UNION ALL SELECT graph_id, node_b, node_a, edge_type, 'both', weight, edge_id FROM u)
SELECT graph_id, node_id, other, edge_type, direction, weight FROM (SELECT w.*, row_number() OVER (PARTITION BY graph_id, node_id ORDER BY weight DESC, edge_id, direction) AS k FROM w SEMI JOIN cand USING (graph_id, node_id)
 WHERE other IS NOT NULL AND weight IS NOT NULL) WHERE k <= 8"""
)
def node_neighbourhoods(spark: SparkSession, sf: str) -> DataFrame:
    return H.neighbourhoods(candidates(spark, sf), directed(spark, sf, *PLAIN_EDGE), undirected(spark, sf, *PAIR_EDGE))


@query(
    f"""WITH {NODES}, {DIRECTED}, {UNDIRECTED}, l AS (SELECT graph_id, from_node AS src, to_node AS dst, edge_type, 'directed' AS kind, weight FROM d UNION ALL SELECT graph_id, node_a, node_b, edge_type, 'undirected', weight FROM u)
SELECT l.graph_id, src AS source, dst AS target, l.edge_type, kind, weight FROM l JOIN n a ON a.graph_id = l.graph_id AND a.node_id = src JOIN n b ON b.graph_id = l.graph_id AND b.node_id = dst"""
)
def view_links(spark: SparkSession, sf: str) -> DataFrame:
    return H.links_for_view(graph_nodes(spark, sf, "graph_id", "node_id"), directed(spark, sf, *PLAIN_EDGE), undirected(spark, sf, *PAIR_EDGE))


CHANGES_SQL = """ch AS (SELECT node_id, CASE WHEN metadata['corrected_at'] IS NOT NULL THEN 'edit' WHEN metadata['forgotten_at'] IS NOT NULL THEN 'supersede' ELSE 'delete' END AS kind,
 CASE WHEN metadata['corrected_at'] IS NOT NULL OR metadata['forgotten_at'] IS NOT NULL THEN 'Note: ' || content END AS content FROM n WHERE metadata['corrected_at'] IS NOT NULL OR metadata['forgotten_at'] IS NOT NULL OR metadata['deleted_at'] IS NOT NULL)"""


def change_rows(nodes: DataFrame) -> DataFrame:
    """Change rows for the nodes that were corrected, forgotten or deleted once."""
    at = lambda k: F.col("metadata")[k].isNotNull()
    kind = F.when(at("corrected_at"), "edit").when(at("forgotten_at"), "supersede").otherwise("delete")
    rows = nodes.where(at("corrected_at") | at("forgotten_at") | at("deleted_at"))
    return rows.select("node_id", kind.alias("kind"), F.when(kind != "delete", F.concat(F.lit("Note: "), "content")).alias("content"), F.lit("review").alias("reason"))


CHANGED = "graph_id", "node_id", "node_type", "content", "entities", "metadata", "confidence", "valid_until"


@query(
    f"""WITH {NODES}, {CHANGES_SQL}, o AS (SELECT node_id, kind, content AS text FROM ch WHERE kind = 'delete' OR content IS NOT NULL)
SELECT graph_id, node_id, CASE WHEN kind = 'edit' THEN text ELSE content END AS content, CASE kind WHEN 'edit' THEN 1.0 WHEN 'delete' THEN 0.1 WHEN 'supersede' THEN least(confidence, 0.3) ELSE confidence END::DOUBLE AS confidence,
 CASE WHEN kind IN ('delete', 'supersede') THEN TIMESTAMP '{AS_OF}' ELSE valid_until END AS valid_until, coalesce(kind, 'none') AS change FROM n LEFT JOIN o USING (node_id)"""
)
def correct_apply(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, *CHANGED)
    return C.corrected_nodes(nodes, change_rows(nodes), AS_OF).drop("entities")


@query(
    f"""WITH {NODES}, {CHANGES_SQL} SELECT graph_id, node_id AS replaces, ch.content, CASE WHEN regexp_matches(lower(ch.content), '\\b(is defined as|refers to|means)\\b') THEN 'definition'
 WHEN regexp_matches(lower(ch.content), '\\b(in \\d{{4}}|founded|invented|created)\\b') THEN 'event' WHEN regexp_matches(lower(ch.content), '\\b(should|must|prefer|always|never)\\b') THEN 'preference' ELSE 'fact' END AS node_type
FROM ch JOIN n USING (node_id) WHERE kind = 'supersede' AND ch.content IS NOT NULL"""
)
def correct_additions(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, *CHANGED)
    return C.added_nodes(nodes, change_rows(nodes)).select("graph_id", "replaces", "content", "node_type")


@query()
def correct_import(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where((F.col("doc_format") == "markdown") & F.col("text").isNotNull()).select("doc_id", "text")
    changes = C.changes_from_markdown(docs, "doc_id", "text")
    return C.added_nodes(graph_nodes(spark, sf, "graph_id", "node_id"), changes).select("node_id", "content", "node_type", "confidence")


FORGET_SQL = f"SELECT graph_id, node_id, TIMESTAMP '{AS_OF}' AS valid_until, 0.1::DOUBLE AS confidence FROM t WHERE (valid_until IS NULL OR valid_until >= TIMESTAMP '{AS_OF}')"


@query(f"WITH {NODES}, {CONTENT} {FORGET_SQL} AND created_at < TIMESTAMP '2024-06-01'")
def forget_time(spark: SparkSession, sf: str) -> DataFrame:
    return C.forgotten_by_time(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "created_at", "valid_until"), "2024-06-01 00:00:00", AS_OF)


@query(f"WITH {NODES}, {CONTENT} {FORGET_SQL} AND (coalesce(contains(lower(content), '{TOPIC.lower()}'), false) OR coalesce(len(list_filter(entities, lambda q: contains(lower(q), '{TOPIC.lower()}'))) > 0, false))")
def forget_topic(spark: SparkSession, sf: str) -> DataFrame:
    return C.forgotten_by_topic(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content", "entities", "valid_until"), TOPIC, AS_OF)


@query(
    f"""WITH {NODES}, {DIRECTED}, s AS (SELECT graph_id, from_node, to_node FROM d WHERE edge_type = 'contains' AND to_node IS NOT NULL),
r AS (SELECT graph_id, node_id AS root, source.file AS file FROM n WHERE metadata['deleted_at'] IS NOT NULL)
SELECT c.graph_id, c.root, c.node_id FROM (WITH RECURSIVE c AS (SELECT r.graph_id, root, n.node_id FROM r JOIN n ON n.graph_id = r.graph_id AND n.source.file = r.file UNION SELECT graph_id, root, root FROM r
  UNION SELECT c.graph_id, c.root, s.to_node FROM c JOIN s ON s.graph_id = c.graph_id AND s.from_node = c.node_id) SELECT * FROM c) c SEMI JOIN n ON n.graph_id = c.graph_id AND n.node_id = c.node_id WHERE c.root <> c.node_id"""
)
def cascade_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What the removal of every deleted node takes with it."""
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "source", "metadata")
    return C.cascade(nodes, directed(spark, sf, *PLAIN_EDGE), nodes.where(F.col("metadata")["deleted_at"].isNotNull()))


@query(f"SELECT graph_id, root, count(*) AS n_taken FROM ({SQL['cascade_closure']}) GROUP BY ALL")
def cascade_closure_all(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes the removal of every deleted node takes with it."""
    return cascade_closure(spark, sf).groupBy("graph_id", "root").agg(F.count(F.lit(1)).alias("n_taken"))


@query("SELECT user_id, max(ts) AS last_accessed_at, count(*) AS access_count FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def access_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.access_stats(table(spark, sf, "events"), "user_id", "ts")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def access_windows(spark: SparkSession, sf: str) -> DataFrame:
    return A.accesses_by_window(table(spark, sf, "events"), "ts", "event_type", "1 hour")


@query("SELECT graph_id, graph_name, updated_at, list_place FROM (SELECT graph_id, graph_name, updated_at, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, graph_id) AS list_place FROM graphs)")
def graph_list(spark: SparkSession, sf: str) -> DataFrame:
    graphs = table(spark, sf, "graphs").select("graph_id", "graph_name", "updated_at")
    return numbered(graphs, [F.desc_nulls_last("updated_at"), "graph_id"], "list_place")
