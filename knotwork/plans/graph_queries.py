"""Queries on edges and upkeep of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import graph as G
from knotwork.operators import references as R
from knotwork.operators import reports as H
from knotwork.plans.registry import DIRECTED, NODES, UNDIRECTED, directed, graph_nodes, query, undirected
from knotwork.plans.text_queries import CONTENT, counts_sql
from knotwork.session import table


def edge_tables(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, list[str]]]:
    return {
        "directed_edges": (table(spark, sf, "directed_edges"), ["from_node", "to_node"]),
        "undirected_edges": (table(spark, sf, "undirected_edges"), ["node_a", "node_b"]),
    }


P3_SQL = """
WITH n AS (
  SELECT graph_id, node_id, min(created_at) AS born,
    min(CASE WHEN regexp_full_match(metadata['deleted_at'], '[0-9]+') THEN make_timestamp(CAST(metadata['deleted_at'] AS BIGINT) * 1000)
             ELSE CAST(rtrim(metadata['deleted_at'], 'Z') AS TIMESTAMP) END) AS gone
  FROM nodes GROUP BY 1, 2),
e AS (
  SELECT 'directed_edges' AS edge_table, edge_id, graph_id, created_at, 'from_node' AS end_name, from_node AS k FROM directed_edges
  UNION ALL SELECT 'directed_edges', edge_id, graph_id, created_at, 'to_node', to_node FROM directed_edges
  UNION ALL SELECT 'undirected_edges', edge_id, graph_id, created_at, 'node_a', node_a FROM undirected_edges
  UNION ALL SELECT 'undirected_edges', edge_id, graph_id, created_at, 'node_b', node_b FROM undirected_edges),
r AS (
  SELECT e.edge_table, e.edge_id, e.end_name, coalesce(strftime(e.created_at, '%Y-%m'), 'none') AS month_key,
    CASE WHEN n.node_id IS NULL THEN 'missing' WHEN n.gone <= e.created_at THEN 'deleted' WHEN n.born > e.created_at THEN 'late' END AS reason
  FROM e LEFT JOIN n ON n.graph_id = e.graph_id AND n.node_id = e.k WHERE e.k IS NOT NULL),
f AS (SELECT DISTINCT edge_table, edge_id, end_name, reason, month_key FROM r WHERE reason IS NOT NULL)
"""


@query(P3_SQL + "SELECT * FROM f")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return R.dangling_references(table(spark, sf, "nodes"), edge_tables(spark, sf))


@query(P3_SQL + "SELECT edge_table, month_key, end_name, reason, count(*) AS n_ends FROM f GROUP BY ALL")
def p3_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return R.references_by_period(table(spark, sf, "nodes"), edge_tables(spark, sf))


PLACES = "graph_id", "node_id", "node_type", "ord", "source"
SECTION_SQL = "PARTITION BY graph_id, source.file, source.section ORDER BY ord, node_id"


@query(f"WITH {NODES}, {CONTENT} SELECT * FROM (SELECT graph_id, lag(node_id) OVER ({SECTION_SQL}) AS from_node, node_id AS to_node, 'precedes' AS edge_type, 0.8::DOUBLE AS weight FROM t) WHERE from_node IS NOT NULL")
def precedes_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.precedes_edges(graph_nodes(spark, sf, *PLACES))


@query(
    f"""WITH {NODES}, {CONTENT}, l AS (SELECT graph_id, node_id AS x, unnest([lead(node_id, 1) OVER w, lead(node_id, 2) OVER w, lead(node_id, 3) OVER w]) AS y FROM t
 WINDOW w AS ({SECTION_SQL}))
SELECT graph_id, least(x, y) AS node_a, greatest(x, y) AS node_b, 'co-occurs' AS edge_type, 0.4::DOUBLE AS weight FROM l WHERE y IS NOT NULL"""
)
def cooccur_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.cooccurrence_edges(graph_nodes(spark, sf, *PLACES))


@query(
    f"""WITH {NODES}, r AS (SELECT graph_id, node_id, node_type, ord, source.file AS file, source.section AS section, try_cast(metadata['depth'] AS INT) AS depth FROM n), h AS (SELECT * FROM r WHERE node_type = 'section'),
dd AS (SELECT graph_id, file, arg_min(node_id, (ord, node_id)) AS p FROM r WHERE node_type = 'document' GROUP BY ALL),
ss AS (SELECT graph_id, file, section, arg_min(node_id, (ord, node_id)) AS p FROM r WHERE node_type = 'section' GROUP BY ALL)
SELECT graph_id, from_node, to_node, 'contains' AS edge_type, 1.0::DOUBLE AS weight FROM (
 SELECT s.graph_id, coalesce((SELECT arg_max(a.node_id, (a.ord, a.node_id)) FROM h a WHERE a.graph_id = s.graph_id AND a.file = s.file AND a.depth < s.depth AND (a.ord, a.node_id) < (s.ord, s.node_id)), dd.p) AS from_node, s.node_id AS to_node
 FROM h s LEFT JOIN dd USING (graph_id, file)) WHERE from_node IS NOT NULL
UNION ALL SELECT graph_id, p, node_id, 'contains', 1.0 FROM r JOIN ss USING (graph_id, file, section) WHERE node_type IS NULL OR node_type NOT IN ('document', 'section')"""
)
def contains_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.contains_edges(graph_nodes(spark, sf, *PLACES, "content", "metadata"))


@query(
    f"""WITH {NODES}, {CONTENT}, h AS (SELECT graph_id, lower(content) AS title, arg_min(node_id, (ord, node_id)) AS to_node FROM n WHERE node_type IN ('document', 'section') GROUP BY 1, 2),
l AS (SELECT graph_id, node_id, unnest(list_concat(regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2), regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1))) AS link FROM t)
SELECT DISTINCT graph_id, node_id AS from_node, to_node, 'cites' AS edge_type, 0.7::DOUBLE AS weight FROM l JOIN h USING (graph_id) WHERE h.title = lower(replace(link, '_', ' '))"""
)
def cites_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.cites_edges(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "content"))


TERM_SQL = """coalesce(nullif(trim(regexp_extract(content, '(?i)^(.+?)\\s+is\\s+defined\\s+as', 1)), ''), nullif(trim(regexp_extract(content, '(?i)^(.+?)\\s+refers?\\s+to', 1)), ''),
 nullif(trim(regexp_extract(content, '(?i)^(.+?)\\s+is\\s+(?:a|an|the)\\s', 1)), ''), nullif(trim(regexp_extract(content, '(?i)^(?:a|an|the)\\s+(.+?)\\s+is\\s', 1)), ''))"""
WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(
    f"""WITH {NODES}, w AS (SELECT graph_id, node_id, lower(content) AS text, {WORDS_SQL.format('content')} AS words FROM n WHERE content IS NOT NULL),
f AS (SELECT graph_id, node_id AS from_node, lower(term) AS term, {WORDS_SQL.format('term')} AS parts FROM (SELECT *, {TERM_SQL} AS term FROM n WHERE node_type = 'definition') WHERE term IS NOT NULL)
SELECT f.graph_id, from_node, node_id AS to_node, 'defines' AS edge_type, 0.6::DOUBLE AS weight FROM f JOIN w ON f.graph_id = w.graph_id AND from_node <> node_id
 AND contains(text, term) AND len(parts) > 0 AND list_has_all(words, parts)"""
)
def defines_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.defines_edges(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content"))


@query(
    f"""WITH {NODES}, {CONTENT}, c AS ({counts_sql('t', 'graph_id, node_id, ord', 'content')}),
z AS (SELECT graph_id, count(*) AS n_texts FROM t GROUP BY 1),
i AS (SELECT graph_id, term, count(*) AS df, ln((any_value(n_texts) + 1) / (count(*) + 1)) + 1 AS idf FROM c JOIN z USING (graph_id) GROUP BY 1, 2),
v AS (SELECT graph_id, node_id, ord, term, df, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY graph_id, node_id)) AS u
      FROM (SELECT *, freq / max(freq) OVER (PARTITION BY graph_id, node_id) AS tf FROM c) JOIN i USING (graph_id, term)),
k AS (SELECT DISTINCT graph_id, a.node_id AS x, b.node_id AS y, a.ord AS ox, b.ord AS oy FROM v a JOIN v b USING (graph_id, term) WHERE (a.ord, a.node_id) < (b.ord, b.node_id)),
s AS (SELECT graph_id, x, y, ox, oy, round(sum(a.u * b.u), 6) AS cosine FROM k JOIN v a USING (graph_id) JOIN v b USING (graph_id, term)
      WHERE a.node_id = x AND b.node_id = y GROUP BY ALL),
e AS (SELECT graph_id, node_id, list_distinct(list_transform(entities, lambda q: lower(q))) AS names FROM t WHERE len(entities) > 0),
p AS (SELECT graph_id, x, y, ox, oy, 'similar-to' AS edge_type, cosine AS weight FROM s WHERE cosine >= 0.3
  UNION ALL SELECT * FROM (SELECT s.graph_id, x, y, ox, oy, 'shares-entity' AS edge_type, round(len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names))), 6) AS weight
   FROM s JOIN e a ON a.graph_id = s.graph_id AND a.node_id = x JOIN e b ON b.graph_id = s.graph_id AND b.node_id = y WHERE cosine < 0.3) WHERE weight >= 0.2),
m AS (SELECT graph_id, x, y, row_number() OVER (PARTITION BY graph_id, me ORDER BY weight DESC, o, other) AS r FROM (
  SELECT *, x AS me, oy AS o, y AS other FROM p UNION ALL SELECT *, y, ox, x FROM p))
SELECT p.graph_id, x AS node_a, y AS node_b, edge_type, weight FROM p JOIN (SELECT graph_id, x, y FROM m WHERE r <= 10 GROUP BY ALL HAVING count(*) = 2) USING (graph_id, x, y)"""
)
def similarity_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.similarity_edges(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "content", "entities"))


SAME_SQL = """h AS (SELECT graph_id, content, arg_min(node_id, (ord, node_id)) AS canonical_id FROM t WHERE content IS NOT NULL GROUP BY 1, 2),
m AS (SELECT t.graph_id, node_id, canonical_id FROM t JOIN h ON t.graph_id = h.graph_id AND t.content = h.content WHERE node_id <> canonical_id)"""


@query(f"WITH {NODES}, {CONTENT}, {SAME_SQL} SELECT * FROM m")
def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return G.duplicates(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "content"))


@query(
    f"""WITH {NODES}, {CONTENT}, {SAME_SQL}, {DIRECTED}, {UNDIRECTED},
x AS (SELECT 'directed' AS kind, d.graph_id, edge_id, coalesce(a.canonical_id, from_node) AS end_1, coalesce(b.canonical_id, to_node) AS end_2 FROM d
  LEFT JOIN m a ON a.graph_id = d.graph_id AND a.node_id = from_node LEFT JOIN m b ON b.graph_id = d.graph_id AND b.node_id = to_node
 UNION ALL SELECT 'undirected', u.graph_id, edge_id, coalesce(a.canonical_id, node_a), coalesce(b.canonical_id, node_b) FROM u
  LEFT JOIN m a ON a.graph_id = u.graph_id AND a.node_id = node_a LEFT JOIN m b ON b.graph_id = u.graph_id AND b.node_id = node_b)
SELECT * FROM x WHERE end_1 <> end_2"""
)
def dedup_edge_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    merged = G.duplicates(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "content"))
    parts = []
    for kind, edges, ends in (("directed", directed, ("from_node", "to_node")), ("undirected", undirected, ("node_a", "node_b"))):
        moved = G.rewrite_ends(edges(spark, sf, "graph_id", *ends), merged, ends)
        parts.append(moved.select(F.lit(kind).alias("kind"), "graph_id", "edge_id", F.col(ends[0]).alias("end_1"), F.col(ends[1]).alias("end_2")))
    return parts[0].unionByName(parts[1])


HELD_SQL = """SELECT graph_id, unnest([from_node, to_node]) AS node_id FROM d WHERE weight >= {0} UNION SELECT graph_id, unnest([node_a, node_b]) FROM u WHERE weight >= {1}"""


@query(f"WITH {NODES}, {DIRECTED}, {UNDIRECTED} SELECT graph_id, node_id, node_type FROM n SEMI JOIN ({HELD_SQL.format(0.6, 0.7)}) USING (graph_id, node_id)")
def prune_orphans(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "node_type")
    one, two = directed(spark, sf, "graph_id", "from_node", "to_node", "weight"), undirected(spark, sf, "graph_id", "node_a", "node_b", "weight")
    return G.pruned_nodes(nodes, one, two, 0.6, 0.7)


ROUNDS = 10


def labels_sql() -> str:
    steps = [
        "uc AS (SELECT u.graph_id, node_a, node_b FROM u SEMI JOIN t ON t.graph_id = u.graph_id AND t.node_id = node_a)",
        "ub AS (SELECT uc.* FROM uc SEMI JOIN t ON t.graph_id = uc.graph_id AND t.node_id = node_b WHERE node_a <> node_b)",
        "b AS (SELECT graph_id, node_a AS x, node_b AS y FROM ub UNION ALL SELECT graph_id, node_b, node_a FROM ub)",
        "l0 AS (SELECT DISTINCT graph_id, x AS node_id, x AS label FROM b)",
    ]
    for i in range(ROUNDS):
        steps.append(
            f"""l{i + 1} AS (SELECT graph_id, node_id, label FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node_id ORDER BY k DESC, label) AS r FROM (
 SELECT b.graph_id, b.x AS node_id, label, count(*) AS k FROM b JOIN l{i} ON l{i}.graph_id = b.graph_id AND l{i}.node_id = b.y GROUP BY ALL)) WHERE r = 1)"""
        )
    return f"WITH {NODES}, {CONTENT}, {UNDIRECTED}, " + ", ".join(steps)


@query(labels_sql() + f" SELECT graph_id, node_id, l.label, l.label = k.label AS settled FROM l{ROUNDS} l JOIN l{ROUNDS - 1} k USING (graph_id, node_id)")
def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    nodes = G.content_only(graph_nodes(spark, sf, "graph_id", "node_id", "node_type"))
    return G.label_rounds(undirected(spark, sf, "graph_id", "node_a", "node_b"), ROUNDS, nodes)


COMMUNITY_SQL = f"""{labels_sql()}, z AS (SELECT graph_id, label, count(*) AS n_members FROM l{ROUNDS} GROUP BY 1, 2 HAVING count(*) >= 3),
k AS (SELECT l.graph_id, l.label, n.node_id, n.ord, n.content, n.entities FROM l{ROUNDS} l JOIN z USING (graph_id, label) JOIN n ON n.graph_id = l.graph_id AND n.node_id = l.node_id)"""


@query(
    f"""{COMMUNITY_SQL}, e AS (SELECT graph_id, label, list(entity ORDER BY c DESC, entity)[1:10] AS entities FROM (SELECT graph_id, label, entity, count(*) AS c FROM (SELECT graph_id, label, unnest(entities) AS entity FROM k) GROUP BY ALL) GROUP BY 1, 2),
s AS (SELECT graph_id, label, left(array_to_string(list(content ORDER BY length(content), ord, node_id)[1:3], ' | '), 300) AS said FROM k WHERE content IS NOT NULL GROUP BY 1, 2)
SELECT graph_id, label, n_members, '[Cluster: ' || coalesce(array_to_string(entities[1:5], ', '), '') || '] ' || coalesce(said, '') AS content FROM z LEFT JOIN e USING (graph_id, label) LEFT JOIN s USING (graph_id, label)"""
)
def community_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "ord", "content", "entities")
    return G.community_nodes(label_propagation(spark, sf), nodes)[0].select("graph_id", "label", "n_members", "content")


@query(f"{labels_sql()} SELECT graph_id, label, node_id AS to_node, 0.7::DOUBLE AS weight FROM l{ROUNDS} JOIN (SELECT graph_id, label FROM l{ROUNDS} GROUP BY 1, 2 HAVING count(*) >= 3) USING (graph_id, label)")
def community_edges(spark: SparkSession, sf: str) -> DataFrame:
    made, edges = G.community_nodes(label_propagation(spark, sf), graph_nodes(spark, sf, "graph_id", "node_id", "ord", "content", "entities"))
    labels = made.select("graph_id", F.col("node_id").alias("from_node"), "label")
    return edges.join(labels, ["graph_id", "from_node"]).select("graph_id", "label", "to_node", "weight")


@query(
    labels_sql()
    + f""", z AS (SELECT graph_id, label, count(*) AS n_members FROM l{ROUNDS} GROUP BY 1, 2 HAVING count(*) >= 3),
e AS (SELECT graph_id, node_id, unnest(list_distinct(list_transform(entities, lambda q: lower(q)))) AS entity FROM n),
c AS (SELECT graph_id, label, entity, count(*) AS k FROM l{ROUNDS} JOIN e USING (graph_id, node_id) GROUP BY ALL)
SELECT graph_id, label, n_members, entity, k AS n FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, label ORDER BY k DESC, entity) AS r FROM c) JOIN z USING (graph_id, label) WHERE r <= 10"""
)
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return H.communities(label_propagation(spark, sf), graph_nodes(spark, sf, "graph_id", "node_id", "entities"))


@query(
    f"""WITH {NODES}, {DIRECTED}, s AS (SELECT graph_id, from_node, to_node FROM d WHERE edge_type IN ('causes', 'depends-on', 'supports')), r AS (SELECT DISTINCT graph_id, node_id FROM n WHERE node_type = 'session-summary')
SELECT * FROM (WITH RECURSIVE c AS (SELECT graph_id, node_id AS root, node_id FROM r UNION SELECT c.graph_id, c.root, s.to_node FROM c JOIN s ON s.graph_id = c.graph_id AND s.from_node = c.node_id WHERE s.to_node IS NOT NULL)
 SELECT * FROM c)"""
)
def reachable_from_summaries(spark: SparkSession, sf: str) -> DataFrame:
    edges = directed(spark, sf, "graph_id", "from_node", "to_node", "edge_type").where(F.col("edge_type").isin("causes", "depends-on", "supports"))
    roots = graph_nodes(spark, sf, "graph_id", "node_id", "node_type").where("node_type = 'session-summary'").select("graph_id", "node_id")
    return G.closure(edges, roots)
