"""Queries that start from questions, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import ask as A
from knotwork.operators import render as N
from knotwork.operators import retrieve as R
from knotwork.operators import runs as U
from knotwork.operators.spread import among
from knotwork.plans.insight_queries import BOOST_SQL, SIX
from knotwork.plans.registry import AS_OF, DIRECTED, NODES, UNDIRECTED, directed, graph_nodes, query, undirected
from knotwork.plans.text_queries import CONTENT, counts_sql
from knotwork.session import materialise, table


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def cue_sql(cue: str, column: str) -> str:
    """Whether a question holds a cue; RE2 has no look-ahead, so what must not follow is taken out first."""
    said = lambda c, p: f"regexp_matches({c}, '(?i)\\b{quoted(p)}\\b')"
    tests = []
    while m := re.search(r"(how \w+) \(\?!((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*)\)\|", cue):
        cut = f"regexp_replace({column}, '{quoted(m[1] + ' ' + f'(?:{m[2]})')}', '#', 'gi')"
        tests.append(said(cut, m[1] + " "))
        cue = cue.replace(m[0], "", 1)
    return "(" + " OR ".join([*tests, said(column, cue)]) + ")"


def kind_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {cue_sql(cue, column)} THEN '{kind}'" for kind, cue in R.CUES) + f" WHEN {column} IS NOT NULL THEN 'single-session-user' END"


def strategy_sql(place: int, kind: str = "kind") -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {str(v[place]).lower()}" for k, v in R.STRATEGIES.items()) + " END"


def parts_sql(column: str) -> str:
    """The parts of a question, in order and each once, as a list."""
    concept = "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){quoted(cue)}') THEN '{words}'" for cue, words in R.CONCEPTS) + " END"
    named = f"""list_concat(list_concat(regexp_extract_all({column}, '\\b{R.PHRASE}\\b', 1), list_transform(regexp_extract_all({column}, '{quoted(R.QUOTE)}', 0), lambda x: substr(x, 2, length(x) - 2))),
 regexp_extract_all({column}, '\\b{R.ACRONYM}\\b', 1))"""
    clauses = f"list_filter(list_transform(regexp_split_to_array({column}, '(?i)\\b{R.JOINTS}\\b'), lambda x: trim(x)), lambda x: length(x) > 10)"
    whole = f"list_filter(list_concat(list_concat([{column}], list_filter({named}, lambda x: lower(x) <> lower({column}))), list_concat([{concept}], {clauses})), lambda x: x IS NOT NULL)"
    return whole


def asked_sql(source: str) -> str:
    """(key, part_no, part) of the questions (key, question) of a source."""
    return f"""SELECT key, unnest(l) AS part, generate_subscripts(l, 1) - 1 AS part_no FROM (SELECT key, list_filter(w, lambda x, i: list_position(w, x) = i)[1:6] AS l FROM (SELECT key, {parts_sql('question')} AS w FROM {source}))"""


ASKED_SQL = f"{NODES}, m AS (SELECT node_id AS key, content AS question FROM n WHERE node_type = 'message' AND content LIKE '%?%')"


@query(f"WITH {ASKED_SQL} SELECT key AS node_id, kind, {strategy_sql(0)} AS max_seeds, {strategy_sql(1)} AS max_nodes FROM (SELECT key, {kind_sql('question')} AS kind FROM m)")
def question_router(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content")
    asked = nodes.where("node_type = 'message' and content like '%?%'").select("node_id", R.question_type(F.col("content")).alias("kind"))
    return asked.select("node_id", "kind", R.strategy_of(F.col("kind"))["max_seeds"].alias("max_seeds"), R.strategy_of(F.col("kind"))["max_nodes"].alias("max_nodes"))


@query(f"WITH {ASKED_SQL} SELECT key AS node_id, part_no, part FROM ({asked_sql('m')})")
def question_parts(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content")
    asked = nodes.where("node_type = 'message' and content like '%?%'")
    return asked.select("node_id", F.posexplode(R.sub_queries(F.col("content"))).alias("part_no", "part"))


def spread_sql(name: str, start: str, edges: tuple[str, str]) -> str:
    """Scores `name`3 after three hops from the seeds `start` over two edge tables."""
    d, u = edges
    out = f"""{name}w AS (SELECT g, x, y, max(w) AS w FROM (SELECT graph_id AS g, from_node AS x, to_node AS y, weight AS w FROM {d} UNION ALL SELECT graph_id, to_node, from_node, weight * 0.5 FROM {d}
  UNION ALL SELECT graph_id, node_a, node_b, weight FROM {u} UNION ALL SELECT graph_id, node_b, node_a, weight FROM {u}) WHERE x IS NOT NULL AND w IS NOT NULL AND (g, y) IN (SELECT (graph_id, node_id) FROM n) GROUP BY 1, 2, 3),
{name}0 AS {start}"""
    front = f"{name}0"
    for i in range(1, 4):
        out += f""", {name}t{i} AS (SELECT q, graph_id, y AS node_id, max(score * 0.6 * w) AS score FROM {front} JOIN {name}w ON x = node_id AND g = graph_id GROUP BY 1, 2, 3),
{name}f{i} AS (SELECT t.* FROM {name}t{i} t LEFT JOIN {name}{i - 1} o USING (q, graph_id, node_id) WHERE t.score > coalesce(o.score, 0)),
{name}{i} AS (SELECT q, graph_id, node_id, max(score) AS score FROM (SELECT * FROM {name}{i - 1} UNION ALL SELECT * FROM {name}f{i}) GROUP BY 1, 2, 3)"""
        front = f"{name}f{i}"
    return out


BLOCKED_SQL = ", ".join(f"'{k}'" for k in A.BLOCKED)
QUERY_SQL = f"""WITH {NODES}, {CONTENT}, {DIRECTED}, {UNDIRECTED}, {BOOST_SQL}, ei AS (SELECT DISTINCT item_id AS key, question FROM eval_items WHERE question IS NOT NULL),
a AS (SELECT q, kind, {strategy_sql(0)} AS max_seeds, {strategy_sql(1)} AS max_nodes, {strategy_sql(2)} AS spread, {strategy_sql(3)} AS summaries FROM (SELECT key AS q, {kind_sql('question')} AS kind FROM ei)),
vr AS (SELECT DISTINCT key AS q, part AS variant FROM ({asked_sql('ei')})),
c AS ({counts_sql('t', 'graph_id, node_id', 'content')}), i AS (SELECT term, ln(((SELECT count(*) FROM t) + 1) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY 1),
w AS (SELECT graph_id, node_id, term, freq * idf AS w, sqrt(sum(freq * idf * freq * idf) OVER (PARTITION BY graph_id, node_id)) AS norm FROM c JOIN i USING (term)),
qc AS ({counts_sql('vr', 'q, variant', 'variant')}), qw AS (SELECT q, variant, term, freq * idf AS x, sqrt(sum(freq * idf * freq * idf) OVER (PARTITION BY q, variant)) AS x_norm FROM qc JOIN i USING (term)),
s AS (SELECT q, variant, graph_id, node_id, round(sum(w * x / (norm * x_norm)), 6) AS score FROM w JOIN qw USING (term) GROUP BY ALL),
po AS (SELECT s.* EXCLUDE score, CASE WHEN node_type = 'session-summary' AND summaries THEN {SIX.format('score * 1.3')} ELSE score END AS score, source.file AS file FROM s JOIN t USING (graph_id, node_id) JOIN a USING (q)
 WHERE score > 0 AND (node_type IS DISTINCT FROM 'session-summary' OR summaries)),
mg AS (SELECT q, graph_id, node_id, max(score) AS score, any_value(file) AS file FROM (SELECT *, row_number() OVER (PARTITION BY q, variant ORDER BY score DESC, node_id, graph_id) AS k FROM po) WHERE k <= 5 GROUP BY 1, 2, 3),
r1 AS (SELECT mg.*, max_seeds, CASE WHEN spread THEN graph_id || '|' || coalesce(file, '') END AS src, row_number() OVER (PARTITION BY q ORDER BY score DESC, node_id) AS n1 FROM mg JOIN a USING (q)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY n1) AS turn, min(n1) OVER (PARTITION BY q, src) AS first_n FROM r1),
sd AS (SELECT q, graph_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY turn, first_n) AS pick FROM r2) WHERE pick <= max_seeds),
db AS (SELECT * FROM d WHERE edge_type <> 'summarizes'), ub AS (SELECT * FROM u WHERE edge_type <> 'summarizes'),
{spread_sql('x', f"(SELECT sd.* FROM sd JOIN a USING (q) WHERE kind NOT IN ({BLOCKED_SQL}))", ('d', 'u'))}, {spread_sql('y', f"(SELECT sd.* FROM sd JOIN a USING (q) WHERE kind IN ({BLOCKED_SQL}))", ('db', 'ub'))},
top AS (SELECT q, graph_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, node_id, graph_id) AS k FROM (
 SELECT q, z.graph_id, z.node_id, {SIX.format('score * f')} AS score FROM (SELECT * FROM x3 UNION ALL SELECT * FROM y3) z JOIN b USING (graph_id, node_id))) JOIN a USING (q) WHERE k <= max_nodes),
su AS (SELECT DISTINCT top.q, top.graph_id, d.to_node AS node_id FROM top JOIN n USING (graph_id, node_id) JOIN d ON d.graph_id = top.graph_id AND d.from_node = top.node_id WHERE node_type = 'session-summary' AND edge_type = 'summarizes'),
we AS (SELECT top.q, top.graph_id, top.node_id, CASE WHEN su.q IS NULL THEN score ELSE {SIX.format('score * 0.5')} END AS score FROM top LEFT JOIN su USING (q, graph_id, node_id)),
sib AS (SELECT we.q, x.graph_id, x.node_id, {SIX.format('max(we.score) * 0.9')} AS score FROM we JOIN n k ON k.node_id = we.node_id AND k.graph_id = we.graph_id JOIN n x ON x.graph_id = k.graph_id AND x.source.file = k.source.file
  AND regexp_full_match(k.source.section, '(?i)assistant \\(turn [0-9]+\\)') AND regexp_full_match(x.source.section, '(?i)user \\(turn [0-9]+\\)') AND regexp_extract(k.source.section, '([0-9]+)\\)$', 1) = regexp_extract(x.source.section, '([0-9]+)\\)$', 1) GROUP BY 1, 2, 3),
fin AS (SELECT q, graph_id, node_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, node_id, graph_id) AS place FROM (SELECT * FROM we UNION ALL SELECT * FROM sib ANTI JOIN we USING (q, graph_id, node_id)))"""
USED = "graph_id", "node_id", "node_type", "content", "source", "last_accessed_at", "access_count", "confidence", "valid_until"
ENDS = {"one": ("graph_id", "from_node", "to_node", "edge_type", "weight"), "two": ("graph_id", "node_a", "node_b", "edge_type", "weight")}


def answers(spark: SparkSession, sf: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The nodes that answer the evaluation questions, over all graphs; and the nodes, with more columns, and edges that were read for it."""
    nodes = materialise(graph_nodes(spark, sf, *USED, *more), "nodes")
    one, two = materialise(directed(spark, sf, *ENDS["one"]), "one"), materialise(undirected(spark, sf, *ENDS["two"]), "two")
    asked = table(spark, sf, "eval_items").select(F.col("item_id").alias("q"), "question")
    return A.ask(nodes, one, two, asked, AS_OF), nodes, one, two


def chosen_edges(best: DataFrame, edges: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """The edges of which both ends answer a question, of which only those that start at an answer leave the scan."""
    return R.edges_between(best, among(edges, best.select("graph_id", F.col("node_id").alias(ends[0])), ["graph_id", ends[0]]), "q", ends)


@query(f"{QUERY_SQL} SELECT q, graph_id, node_id, score, place FROM fin")
def query_graph(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf)[0]


@query(
    f"""{QUERY_SQL} SELECT q, count(*) AS n_nodes, (SELECT count(*) FROM d JOIN fin x ON x.graph_id = d.graph_id AND x.node_id = from_node JOIN fin y ON y.graph_id = d.graph_id AND y.node_id = to_node AND y.q = x.q WHERE x.q = fin.q) AS n_directed,
 (SELECT count(*) FROM u JOIN fin x ON x.graph_id = u.graph_id AND x.node_id = node_a JOIN fin y ON y.graph_id = u.graph_id AND y.node_id = node_b AND y.q = x.q WHERE x.q = fin.q) AS n_undirected FROM fin GROUP BY q"""
)
def query_subgraph_sizes(spark: SparkSession, sf: str) -> DataFrame:
    best, _, one, two = answers(spark, sf)
    best = materialise(best, "answers")
    one = chosen_edges(best, one, ("from_node", "to_node")).groupBy("q").agg(F.count(F.lit(1)).alias("n_directed"))
    two = chosen_edges(best, two, ("node_a", "node_b")).groupBy("q").agg(F.count(F.lit(1)).alias("n_undirected"))
    out = best.groupBy("q").agg(F.count(F.lit(1)).alias("n_nodes")).join(one, "q", "left").join(two, "q", "left")
    return out.select("q", "n_nodes", F.coalesce("n_directed", F.lit(0)).alias("n_directed"), F.coalesce("n_undirected", F.lit(0)).alias("n_undirected"))


@query(f"{QUERY_SQL} SELECT q, node_type, count(*) AS n FROM fin JOIN n USING (graph_id, node_id) GROUP BY 1, 2")
def query_node_types(spark: SparkSession, sf: str) -> DataFrame:
    best, nodes, _, _ = answers(spark, sf)
    return U.type_distribution(best, nodes.select("graph_id", "node_id", "node_type"), "q")


@query(f"WITH {ASKED_SQL} SELECT key AS node_id, regexp_matches(question, '(?i)\\b{R.SUMS}\\b') AS asks_for_sum, regexp_matches(question, '(?i)\\b{R.TASTES}\\b') AS asks_for_taste FROM m")
def question_intents(spark: SparkSession, sf: str) -> DataFrame:
    asked = graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content").where("node_type = 'message' and content like '%?%'")
    return asked.select("node_id", R.asks_for_sum(F.col("content")).alias("asks_for_sum"), R.asks_for_taste(F.col("content")).alias("asks_for_taste"))


@query()
def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    best, nodes, one, two = answers(spark, sf, "metadata")
    best = materialise(best, "answers")
    nodes = among(nodes.select("graph_id", "node_id", "node_type", "content", "source", "metadata"), best, ["graph_id", "node_id"])
    one = materialise(chosen_edges(best, one, ("from_node", "to_node")), "one")
    two = materialise(chosen_edges(best, two, ("node_a", "node_b")), "two")
    return N.subgraph_texts(best, nodes, one, two, "q")
