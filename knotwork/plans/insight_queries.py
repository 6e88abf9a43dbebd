"""Queries on reflection, persons, retrieval, corrections, reports and accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators import evaluate as V
from knotwork.operators import identities as P
from knotwork.operators import providers as M
from knotwork.operators import reflect as S
from knotwork.operators import render as N
from knotwork.operators import reports as H
from knotwork.operators import retrieve as R
from knotwork.plans.registry import AS_OF, DIRECTED, NODES, UNDIRECTED, directed, graph_nodes, query, undirected
from knotwork.plans.text_queries import CONTENT, counts_sql, question_seeds
from knotwork.session import materialise, table

SIX = "floor(({0}) * 1000000 + 0.5) / 1000000"
CONFLICT_SQL = """regexp_matches(lower({0}), '\\bnot\\s+(?:a|an|the)\\s|\\bno longer\\b|\\bwas\\s+(?:not|never)\\b|\\breplaced\\s+by\\b|\\bcontrary\\s+to\\b|\\bis\\s+(?:incorrect|wrong|false|inaccurate)\\b|\\bwas\\s+(?:incorrect|wrong|false|inaccurate)\\b|\\breclassified\\b|\\bdisputed\\b|\\bdisproven\\b')"""
LOWER_SQL = "list_distinct(list_transform({0}, lambda q: lower(q)))"


def contradiction_sql(overlap: float, likeness: float) -> str:
    return f"""WITH {NODES}, {CONTENT}, k AS (SELECT * FROM t WHERE node_type <> 'person' AND length(content) >= 50),
e AS (SELECT DISTINCT graph_id, node_id, ord, unnest(entities) AS name FROM k),
f AS (SELECT * FROM e WHERE length(name) >= 4 AND NOT regexp_full_match(name, '[0-9]+') AND lower(name) NOT IN ({', '.join(f"'{w}'" for w in S.GENERIC)})),
l AS (SELECT DISTINCT graph_id, CASE WHEN (x.ord, x.node_id) < (y.ord, y.node_id) THEN x.node_id ELSE y.node_id END AS a, CASE WHEN (x.ord, x.node_id) < (y.ord, y.node_id) THEN y.node_id ELSE x.node_id END AS b FROM f x JOIN f y USING (graph_id, name) WHERE x.node_id < y.node_id),
p AS (SELECT l.graph_id, a, b, len(list_intersect(list_filter({LOWER_SQL.format('x.entities')}, lambda q: length(q) >= 4), {LOWER_SQL.format('y.entities')})) AS n_shared,
  len(list_intersect({LOWER_SQL.format('x.entities')}, {LOWER_SQL.format('y.entities')})) / len(list_distinct(list_concat({LOWER_SQL.format('x.entities')}, {LOWER_SQL.format('y.entities')}))) AS o
 FROM l JOIN k x ON x.graph_id = l.graph_id AND x.node_id = a JOIN k y ON y.graph_id = l.graph_id AND y.node_id = b
 WHERE length(x.content) >= 80 AND length(y.content) >= 80 AND ({CONFLICT_SQL.format('x.content')} OR {CONFLICT_SQL.format('y.content')})),
c AS ({counts_sql('k', 'graph_id, node_id', 'content')}), z AS (SELECT graph_id, count(*) AS n_texts FROM k GROUP BY 1),
i AS (SELECT graph_id, term, ln((any_value(n_texts) + 1) / (count(*) + 1)) + 1 AS idf FROM c JOIN z USING (graph_id) GROUP BY 1, 2),
v AS (SELECT graph_id, node_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY graph_id, node_id)) AS u FROM (SELECT *, freq / max(freq) OVER (PARTITION BY graph_id, node_id) AS tf FROM c) JOIN i USING (graph_id, term)),
s AS (SELECT p.graph_id, a, b, round(sum(x.u * y.u), 6) AS cosine FROM p JOIN v x ON x.graph_id = p.graph_id AND x.node_id = a JOIN v y ON y.graph_id = p.graph_id AND y.node_id = b AND y.term = x.term GROUP BY 1, 2, 3)
SELECT p.graph_id, p.a AS node_a, p.b AS node_b, n_shared FROM p LEFT JOIN s ON s.graph_id = p.graph_id AND s.a = p.a AND s.b = p.b WHERE n_shared >= 2 AND o > {overlap} AND coalesce(cosine, 0) < {likeness}"""


@query(contradiction_sql(0.6, 0.15))
def contradiction_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.contradictions(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "content", "entities"))


@query(contradiction_sql(0.0, 2.0))
def contradiction_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The same without bounds on overlap and likeness: all pairs with two names in common of which one disagrees, for a person to look at."""
    return S.contradictions(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "content", "entities"), 0.0, 2.0)


@query(
    f"""WITH {NODES}, {CONTENT}, {UNDIRECTED}, r AS (SELECT graph_id, node_id, entities, split_part(source.file, ':', 1) AS dom FROM t),
e AS (SELECT graph_id, node_id, dom, unnest({LOWER_SQL.format('entities')}) AS name FROM r),
p AS (SELECT graph_id, a.node_id AS node_a, b.node_id AS node_b, count(*) AS n_bridges FROM e a JOIN e b USING (graph_id, name) WHERE a.node_id < b.node_id AND a.dom <> b.dom GROUP BY 1, 2, 3 HAVING count(*) >= 2),
q AS (SELECT *, least(round(n_bridges * 0.2, 6), 0.9)::DOUBLE AS surprise FROM p ANTI JOIN (SELECT graph_id, least(node_a, node_b) AS node_a, greatest(node_a, node_b) AS node_b FROM u) USING (graph_id, node_a, node_b))
SELECT graph_id, node_a, node_b, n_bridges, surprise FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY surprise DESC, node_a, node_b) AS k FROM q) WHERE k <= 20"""
)
def cross_domain_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return S.discoveries(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "entities", "source"), undirected(spark, sf, "graph_id", "node_a", "node_b"))


@query(
    f"""WITH {NODES}, {CONTENT}, g AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(last_accessed_at, created_at))) / 86400000000.0 AS days FROM t WHERE node_type <> 'person'),
h AS (SELECT *, confidence * greatest(0.5, 1 - (days - 7) * 0.01) AS c2 FROM g WHERE days > 7)
SELECT * FROM (SELECT graph_id, node_id, confidence, round(greatest(0.1, c2), 6) AS decayed FROM h WHERE c2 < confidence) WHERE decayed < confidence"""
)
def confidence_decay(spark: SparkSession, sf: str) -> DataFrame:
    return S.confidence_decay(graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "confidence", "last_accessed_at", "created_at"), AS_OF)


@query(
    f"""WITH {DIRECTED}, h AS (SELECT * FROM d WHERE edge_type IN ('causes', 'depends-on', 'supports') AND weight IS NOT NULL),
w AS (SELECT a.graph_id, a.from_node, b.to_node, a.edge_type, {SIX.format('a.weight * b.weight * 0.5')} AS weight FROM h a JOIN h b ON b.graph_id = a.graph_id AND b.from_node = a.to_node AND b.edge_type = a.edge_type WHERE a.from_node <> b.to_node),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, from_node, to_node ORDER BY weight DESC, edge_type DESC) AS r FROM w WHERE weight >= 0.15) WHERE r = 1),
y AS (SELECT * FROM x ANTI JOIN (SELECT graph_id, from_node, to_node FROM d) USING (graph_id, from_node, to_node))
SELECT graph_id, from_node, to_node, edge_type, weight FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, from_node, to_node) AS k FROM y) WHERE k <= 100"""
)
def transitive_infer(spark: SparkSession, sf: str) -> DataFrame:
    return S.inferred_edges(directed(spark, sf, "graph_id", "from_node", "to_node", "edge_type", "weight"))


MENTIONS_SQL = f"""{NODES}, e AS (SELECT graph_id, node_id, ord, created_at, unnest(entities) AS entity FROM n),
m AS (SELECT DISTINCT graph_id, regexp_replace(entity, '\\s+', ' ', 'g') AS name, node_id, ord, created_at FROM e WHERE regexp_full_match(entity, '[A-Z][a-z]+(\\s+[A-Z][a-z]+)+')),
p AS (SELECT graph_id, name, count(*) AS n_mentions, min(created_at) AS first_seen, max(created_at) AS last_seen, least(round(0.5 + count(*) * 0.1, 6), 0.95)::DOUBLE AS confidence FROM m GROUP BY 1, 2 HAVING count(*) >= 2)"""
MENTIONED = "graph_id", "node_id", "ord", "created_at", "entities"


@query(f"WITH {MENTIONS_SQL} SELECT graph_id, name, n_mentions, first_seen, last_seen, confidence FROM p")
def person_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return P.persons(P.mentions(graph_nodes(spark, sf, *MENTIONED))).drop("person_id")


@query(
    f"""WITH {MENTIONS_SQL}, k AS (SELECT m.* FROM m JOIN p USING (graph_id, name))
SELECT graph_id, a.name AS name_a, b.name AS name_b, count(*) AS n_nodes, least(round(0.3 + count(*) * 0.1, 6), 0.9)::DOUBLE AS weight FROM k a JOIN k b USING (graph_id, node_id) WHERE a.name < b.name GROUP BY 1, 2, 3"""
)
def person_relations(spark: SparkSession, sf: str) -> DataFrame:
    found = P.mentions(graph_nodes(spark, sf, *MENTIONED))
    return P.person_relations(found, P.persons(found))


@query(
    f"""WITH {MENTIONS_SQL}, k AS (SELECT m.* FROM m JOIN p USING (graph_id, name)),
l AS (SELECT graph_id, node_id AS x, unnest([lead(node_id, 1) OVER w, lead(node_id, 2) OVER w, lead(node_id, 3) OVER w, lead(node_id, 4) OVER w]) AS y FROM k WINDOW w AS (PARTITION BY graph_id, name ORDER BY ord, node_id))
SELECT DISTINCT graph_id, least(x, y) AS node_a, greatest(x, y) AS node_b FROM l WHERE y IS NOT NULL"""
)
def person_links(spark: SparkSession, sf: str) -> DataFrame:
    found = P.mentions(graph_nodes(spark, sf, *MENTIONED))
    return P.person_links(found, P.persons(found))


@query(
    f"""WITH {MENTIONS_SQL}, k AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY graph_id, name ORDER BY m.ord, node_id) AS r FROM m JOIN p USING (graph_id, name)) WHERE r <= 10),
s AS (SELECT k.graph_id, name, r, lower(content) AS text, instr(lower(content), lower(name)) AS pos, length(name) AS ln FROM k JOIN n USING (graph_id, node_id)),
o AS (SELECT *, regexp_extract(substr(text, greatest(pos - 100, 1), ln + 100 + least(pos - 1, 100)), '({'|'.join(r.replace('.', chr(92) + '.') for r in P.ROLES)})', 1) AS role FROM s WHERE pos > 0)
SELECT graph_id, name, arg_min(role, r) AS role FROM o WHERE role <> '' GROUP BY 1, 2"""
)
def person_roles(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, *MENTIONED, "content")
    found = P.mentions(nodes)
    return P.person_roles(found, P.persons(found), nodes)


@query(
    f"""WITH {NODES}, e AS (SELECT graph_id, unnest(entities) AS entity FROM n WHERE lower(metadata['role']) = 'user')
SELECT graph_id, entity, n, place FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, entity) AS place FROM (SELECT graph_id, entity, count(*) AS n FROM e GROUP BY 1, 2)) WHERE place <= 20"""
)
def user_preferences(spark: SparkSession, sf: str) -> DataFrame:
    return P.user_preferences(graph_nodes(spark, sf, "graph_id", "node_id", "metadata", "entities"))


@query(
    f"""WITH {NODES}, e AS (SELECT graph_id, split_part(source.file, ':', 1) AS domain FROM n WHERE lower(metadata['role']) = 'user' AND source.file IS NOT NULL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, domain) AS place FROM (SELECT graph_id, domain, count(*) AS n FROM e GROUP BY 1, 2)) WHERE place <= 10"""
)
def user_domains(spark: SparkSession, sf: str) -> DataFrame:
    return P.user_domains(graph_nodes(spark, sf, "graph_id", "node_id", "metadata", "source"))


@query(f"WITH {MENTIONS_SQL} SELECT m.graph_id, node_id AS from_node, 'cites' AS edge_type, 0.6::DOUBLE AS weight, 'Mentions ' || name AS evidence FROM m JOIN p USING (graph_id, name)")
def person_edges(spark: SparkSession, sf: str) -> DataFrame:
    found = P.mentions(graph_nodes(spark, sf, *MENTIONED))
    return P.person_edges(found, P.persons(found)).drop("to_node")


@query()
def session_summaries(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "content", "source")
    said = nodes.where("node_type = 'message'").select("graph_id", F.col("source.file").alias("file"), "ord", "content")
    prompts = M.session_prompts(said, ["graph_id", "file"], "content", "ord").withColumn("k", F.struct(F.concat_ws("|", "graph_id", "file").alias("k"), "part_no"))
    answers = M.answered(prompts.withColumn("k", F.to_json("k")), "k", "prompt", M.FirstSentences)
    parts = answers.select(F.from_json("k", "k string, part_no int").alias("k"), M.json_in(F.col("answer"), M.ENRICHMENT)["synthesis"].alias("summary"))
    return M.session_answers(parts.select("k.k", "k.part_no", "summary"), ["k"], "part_no", "summary")


@query()
def miss_buckets(spark: SparkSession, sf: str) -> DataFrame:
    seeds = question_seeds(spark, sf)
    counts = seeds.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_found"), F.min_by("doc_id", "seed_no").alias("doc_id"))
    items = table(spark, sf, "eval_items").select("item_id", "question", "question_type", "answer").dropDuplicates(["item_id"])
    said = items.join(counts, "item_id", "left").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "left")
    missed = said.where(~F.coalesce(F.contains(F.lower("text"), F.lower("answer")), F.lit(False)))
    bucket = V.miss_bucket(R.question_type(F.col("question")), F.col("question_type"), F.col("n_found"), F.col("text"), F.col("answer"))
    return missed.select("item_id", "question_type", bucket.alias("bucket"))


SYNONYMS_SQL = f"""{NODES}, {UNDIRECTED}, e AS (SELECT graph_id, node_id, lower(unnest(entities)) AS e FROM n),
sy AS (SELECT graph_id, term, related, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, term ORDER BY weight DESC, related) AS place FROM (
 SELECT u.graph_id, a.e AS term, b.e AS related, round(sum(weight), 6) AS weight FROM u JOIN e a ON a.graph_id = u.graph_id AND a.node_id = node_a JOIN e b ON b.graph_id = u.graph_id AND b.node_id = node_b
 WHERE edge_type IN ('similar-to', 'shares-entity') AND weight >= 0.4 AND a.e <> b.e GROUP BY ALL)) WHERE place <= 5 AND weight > 0.5)"""


@query(f"WITH {SYNONYMS_SQL} SELECT * FROM sy")
def synonym_map(spark: SparkSession, sf: str) -> DataFrame:
    return R.synonym_map(graph_nodes(spark, sf, "graph_id", "node_id", "entities"), undirected(spark, sf, "graph_id", "node_a", "node_b", "edge_type", "weight"))


@query()
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content", "metadata")
    questions = nodes.where("node_type = 'message' and content like '%?%'").select("node_id", "content")
    return R.expanded(questions, synonym_map(spark, sf), "node_id", "content")


SEEDS_SQL = f"""{NODES}, {DIRECTED}, {UNDIRECTED}, s0 AS (SELECT graph_id AS q, node_id, 1.0 / r AS score FROM (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY access_count DESC, node_id) AS r FROM n) WHERE r <= 5),
ways AS (SELECT g, x, y, max(w) AS w FROM (SELECT graph_id AS g, from_node AS x, to_node AS y, weight AS w FROM d UNION ALL SELECT graph_id, to_node, from_node, weight * 0.5 FROM d UNION ALL SELECT graph_id, node_a, node_b, weight FROM u
  UNION ALL SELECT graph_id, node_b, node_a, weight FROM u) WHERE x IS NOT NULL AND w IS NOT NULL AND (g, y) IN (SELECT (graph_id, node_id) FROM n) GROUP BY 1, 2, 3)"""


def hops_sql() -> str:
    out, f = SEEDS_SQL, "s0"
    for i in range(1, 4):
        out += f""", t{i} AS (SELECT q, y AS node_id, max(score * 0.6 * w) AS score FROM {f} JOIN ways ON x = node_id AND g = q GROUP BY 1, 2),
f{i} AS (SELECT t.q, t.node_id, t.score FROM t{i} t LEFT JOIN s{i - 1} o ON o.q = t.q AND o.node_id = t.node_id WHERE t.score > coalesce(o.score, 0)),
s{i} AS (SELECT q, node_id, max(score) AS score FROM (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM f{i}) GROUP BY 1, 2)"""
        f = f"f{i}"
    return f"WITH {out}"


def popular_seeds(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "access_count")
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("access_count"), "node_id"))
    return nodes.withColumn("r", rank).where("r <= 5").select(F.col("graph_id").alias("q"), "graph_id", "node_id", (1.0 / F.col("r")).alias("score"))


def all_ways(spark: SparkSession, sf: str, blocked: tuple[str, ...] = ()) -> DataFrame:
    one, two = directed(spark, sf, "graph_id", "from_node", "to_node", "edge_type", "weight"), undirected(spark, sf, "graph_id", "node_a", "node_b", "edge_type", "weight")
    return R.neighbours(one, two, graph_nodes(spark, sf, "graph_id", "node_id"), blocked=blocked)


@query(hops_sql() + f" SELECT q, node_id, {SIX.format('score')} AS score FROM s3")
def bfs_traverse(spark: SparkSession, sf: str) -> DataFrame:
    return R.traverse(popular_seeds(spark, sf), all_ways(spark, sf), "q").select("q", "node_id", X.six(F.col("score")).alias("score"))


FACTOR_SQL = f"""CASE WHEN days < 1 THEN 1.3::DOUBLE WHEN days < 7 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN access_count > 10 THEN 1.2::DOUBLE WHEN access_count > 3 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
 * confidence * CASE WHEN TIMESTAMP '{AS_OF}' > valid_until THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END"""
BOOST_SQL = f"b AS (SELECT *, {FACTOR_SQL} AS f FROM (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_accessed_at)) / 86400000000.0 AS days FROM n))"
USED = "graph_id", "node_id", "last_accessed_at", "access_count", "confidence", "valid_until"


@query(f"WITH {NODES}, {BOOST_SQL} SELECT graph_id, node_id, round(f, 6) AS factor FROM b")
def temporal_boost(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(AS_OF).cast("timestamp_ntz")
    factor = R.temporal_factor(F.col("last_accessed_at"), F.col("access_count"), F.col("confidence"), F.col("valid_until"), now)
    return graph_nodes(spark, sf, *USED).select("graph_id", "node_id", F.round(factor, 6).alias("factor"))


TOP_SQL = f"""{hops_sql()}, {BOOST_SQL}, top AS (SELECT q, node_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, node_id) AS place
 FROM (SELECT q, s3.node_id, {SIX.format('score * f')} AS score FROM s3 JOIN b ON b.node_id = s3.node_id AND b.graph_id = q)) WHERE place <= 20)"""


def best_nodes(spark: SparkSession, sf: str) -> DataFrame:
    scores = R.traverse(popular_seeds(spark, sf), all_ways(spark, sf), "q")
    return R.top_nodes(scores, graph_nodes(spark, sf, *USED), "q", AS_OF, 20)


@query(f"{TOP_SQL} SELECT q, node_id, score, place FROM top")
def retrieve_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return best_nodes(spark, sf).drop("graph_id")


@query(
    f"""{TOP_SQL} SELECT a.q, edge_id, 'directed' AS kind, from_node AS end_1, to_node AS end_2 FROM d JOIN top a ON a.node_id = from_node AND a.q = graph_id JOIN top b ON b.node_id = to_node AND b.q = a.q
 UNION ALL SELECT a.q, edge_id, 'undirected', node_a, node_b FROM u JOIN top a ON a.node_id = node_a AND a.q = graph_id JOIN top b ON b.node_id = node_b AND b.q = a.q"""
)
def subgraph_edges(spark: SparkSession, sf: str) -> DataFrame:
    chosen = best_nodes(spark, sf)
    one = R.edges_between(chosen, directed(spark, sf, "graph_id", "from_node", "to_node"), "q", ("from_node", "to_node"))
    two = R.edges_between(chosen, undirected(spark, sf, "graph_id", "node_a", "node_b"), "q", ("node_a", "node_b"))
    return one.select("q", "edge_id", F.lit("directed").alias("kind"), F.col("from_node").alias("end_1"), F.col("to_node").alias("end_2")).unionByName(
        two.select("q", "edge_id", F.lit("undirected").alias("kind"), F.col("node_a").alias("end_1"), F.col("node_b").alias("end_2"))
    )


@query()
def subgraph_text(spark: SparkSession, sf: str) -> DataFrame:
    chosen = materialise(best_nodes(spark, sf), "best")
    nodes = graph_nodes(spark, sf, "graph_id", "node_id", "node_type", "content", "source", "metadata")
    one = R.edges_between(chosen, directed(spark, sf, "graph_id", "from_node", "to_node", "edge_type", "weight"), "q", ("from_node", "to_node"))
    two = R.edges_between(chosen, undirected(spark, sf, "graph_id", "node_a", "node_b", "edge_type", "weight"), "q", ("node_a", "node_b"))
    return N.subgraph_texts(chosen, nodes, materialise(one, "one"), materialise(two, "two"), "q")


@query(f"{TOP_SQL} SELECT q, n.node_id, score, metadata['synthesis'] AS synthesis, metadata['context'] AS context FROM top JOIN n ON n.node_id = top.node_id AND graph_id = q WHERE score >= 0.1 AND metadata['synthesis'] IS NOT NULL")
def enriched_insights(spark: SparkSession, sf: str) -> DataFrame:
    return H.insights(best_nodes(spark, sf), graph_nodes(spark, sf, "graph_id", "node_id", "metadata"))


@query(
    f"""{TOP_SQL}, sib AS (SELECT t.q, x.node_id, {SIX.format('max(t.score) * 0.9')} AS score FROM top t JOIN n a ON a.node_id = t.node_id AND a.graph_id = t.q JOIN n x ON x.graph_id = a.graph_id AND x.source.file = a.source.file
  AND regexp_full_match(a.source.section, '(?i)assistant \\(turn [0-9]+\\)') AND regexp_full_match(x.source.section, '(?i)user \\(turn [0-9]+\\)') AND regexp_extract(a.source.section, '([0-9]+)\\)$', 1) = regexp_extract(x.source.section, '([0-9]+)\\)$', 1)
  GROUP BY 1, 2)
SELECT q, node_id, score FROM top UNION ALL SELECT q, node_id, score FROM sib ANTI JOIN top USING (q, node_id)"""
)
def sibling_turns(spark: SparkSession, sf: str) -> DataFrame:
    return R.sibling_turns(best_nodes(spark, sf), graph_nodes(spark, sf, "graph_id", "node_id", "source"), "q").drop("graph_id")


@query(
    f"""{TOP_SQL}, su AS (SELECT DISTINCT t.q, d.to_node AS node_id FROM top t JOIN n ON n.node_id = t.node_id AND n.graph_id = t.q JOIN d ON d.from_node = t.node_id AND d.graph_id = t.q WHERE node_type = 'session-summary' AND edge_type = 'summarizes')
SELECT t.q, t.node_id, {SIX.format('CASE WHEN su.q IS NULL THEN score ELSE score * 0.5 END')} AS score FROM top t LEFT JOIN su ON su.q = t.q AND su.node_id = t.node_id"""
)
def summary_children(spark: SparkSession, sf: str) -> DataFrame:
    weak = R.weakened_by_summary(best_nodes(spark, sf), graph_nodes(spark, sf, "graph_id", "node_id", "node_type"), directed(spark, sf, "graph_id", "from_node", "to_node", "edge_type"), "q")
    return weak.select("q", "node_id", X.six(F.col("score")).alias("score"))


COSINE_SQL = "v AS (SELECT q.vec_id AS q, e.vec_id, e.label, q.label AS q_label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"


def vector_likeness(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's cosine with a stated query set: the vectors whose id is divisible by 100."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query"))
    return R.likeness(vectors.select("vec_id", "embedding", "label"), "embedding", asked)


@query(f"WITH {COSINE_SQL} SELECT q, vec_id, cosine, place FROM (SELECT q, vec_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 6) DESC, vec_id) AS place FROM v WHERE round(cosine, 6) >= 0.2) WHERE place <= 16")
def embedding_topk(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    near = vector_likeness(spark, sf).select("q", "vec_id", F.round("cosine", 6).alias("cosine")).where("cosine >= 0.2")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "vec_id"))).where("place <= 16")


@query(
    f"""WITH {COSINE_SQL}, a AS (SELECT q, vec_id, 1.0 / (1 + vec_id) AS score FROM v WHERE label = q_label), m AS (SELECT q, vec_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT q, vec_id, round(cosine, 6) FROM v WHERE round(cosine, 6) >= 0.2) GROUP BY 1, 2)
SELECT q, vec_id, round(score, 6) AS score FROM m"""
)
def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    near = vector_likeness(spark, sf)
    own = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "label")
    same = near.join(own, ["q", "label"]).select("q", "vec_id", (1.0 / (1 + F.col("vec_id"))).alias("score"))
    like = near.select("q", "vec_id", F.round("cosine", 6).alias("score")).where("score >= 0.2")
    return R.merged_seeds(same, like, key="q", node="vec_id").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {COSINE_SQL}, a AS (SELECT q, vec_id, 1.0 / (1 + vec_id) AS score FROM v WHERE label = q_label)
SELECT q, vec_id, {SIX.format('0.5 * (score / max(score) OVER (PARTITION BY q)) + 0.5 * greatest(round(cosine, 9), 0)')} AS score FROM a JOIN v USING (q, vec_id)"""
)
def rerank_blend(spark: SparkSession, sf: str) -> DataFrame:
    near = vector_likeness(spark, sf)
    own = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "label")
    scores = near.join(own, ["q", "label"]).select("q", "vec_id", (1.0 / (1 + F.col("vec_id"))).alias("score"))
    return R.reranked(scores, near.select("q", "vec_id", F.round("cosine", 9).alias("cosine")), "q", "vec_id")
