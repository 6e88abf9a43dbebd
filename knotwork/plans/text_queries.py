"""Queries on terms, chunks, names and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators import graph as G
from knotwork.operators import index as I
from knotwork.plans.registry import NODES, content_nodes, query
from knotwork.session import materialise, table

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"


def counts_sql(table_name: str, keys: str, text: str) -> str:
    """The terms of a table's texts with their frequency."""
    words = f"unnest(regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'))"
    return f"SELECT {keys}, term, count(*) AS freq FROM (SELECT {keys}, {words} AS term FROM {table_name}) WHERE length(term) > 1 AND term NOT IN {STOP_SQL} GROUP BY ALL"


DOC_COUNTS = f"c AS ({counts_sql('documents', 'doc_id', 'text')})"
DOC_INDEX = f"""{DOC_COUNTS},
i AS (SELECT term, count(*) AS df, ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY 1),
w AS (SELECT doc_id, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS norm
      FROM (SELECT *, freq / max(freq) OVER (PARTITION BY doc_id) AS tf FROM c) JOIN i USING (term)),
qc AS ({counts_sql('eval_items', 'item_id', 'question')}),
q AS (SELECT item_id, term, tf * idf AS q, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS q_norm
      FROM (SELECT *, freq / max(freq) OVER (PARTITION BY item_id) AS tf FROM qc) JOIN i USING (term)),
s AS (SELECT item_id, doc_id, round(sum(w.w * q.q / (norm * q_norm)), 6) AS score FROM w JOIN q USING (term) GROUP BY 1, 2),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS seed_no FROM s WHERE score > 0) WHERE seed_no <= 5)"""


def document_counts(spark: SparkSession, sf: str) -> DataFrame:
    return I.term_counts(table(spark, sf, "documents"), ["doc_id"], "text")


@query(f"WITH {DOC_COUNTS} SELECT doc_id, term, freq FROM c")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    return document_counts(spark, sf)


@query(f"WITH {DOC_COUNTS} SELECT doc_id, term, round(freq / max(freq) OVER (PARTITION BY doc_id), 6) AS tf FROM c")
def tf_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return I.term_frequencies(document_counts(spark, sf), ["doc_id"]).select("doc_id", "term", F.round("tf", 6).alias("tf"))


def node_terms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = content_nodes(spark, sf, "graph_id", "node_id", "node_type", "content")
    return I.term_counts(nodes, ["graph_id", "node_id"], "content"), nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_texts"))


CONTENT = "t AS (SELECT * FROM n WHERE node_type IS NULL OR node_type NOT IN ('document', 'section'))"
NODE_COUNTS = f"{NODES}, {CONTENT}, c AS ({counts_sql('t', 'graph_id, node_id', 'content')})"


@query(
    f"""WITH {NODE_COUNTS}, s AS (SELECT graph_id, count(*) AS n_texts FROM t GROUP BY 1)
SELECT graph_id, term, count(*) AS df, round(ln((any_value(n_texts) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM c JOIN s USING (graph_id) GROUP BY 1, 2"""
)
def idf_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    counts, sizes = node_terms(spark, sf)
    return I.inverse_frequencies(counts, sizes, ["graph_id"]).withColumn("idf", F.round("idf", 6))


def question_seeds(spark: SparkSession, sf: str, top: int = 5) -> DataFrame:
    docs = table(spark, sf, "documents")
    counts = materialise(I.term_counts(docs, ["doc_id"], "text"), "terms")
    idf = I.inverse_frequencies(counts, docs.agg(F.count_distinct("doc_id").alias("n_texts")), [])
    return I.search(counts, table(spark, sf, "eval_items").select("item_id", "question"), idf, "item_id", "question", ["doc_id"], top)


@query(f"WITH {DOC_INDEX} SELECT item_id, doc_id, score, seed_no FROM seeds")
def seed_search(spark: SparkSession, sf: str) -> DataFrame:
    return question_seeds(spark, sf)


@query(
    f"""WITH {DOC_INDEX}, p AS (SELECT s.*, coalesce(d.source, '') AS source FROM s JOIN documents d USING (doc_id) WHERE score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS turn FROM r WHERE n <= 40),
b AS (SELECT *, min(n) OVER (PARTITION BY item_id, source) AS first_n, count(*) OVER (PARTITION BY item_id) AS pool FROM k)
SELECT item_id, doc_id, source, pick_no FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY turn, first_n) AS pick_no FROM b) WHERE pick_no <= 20"""
)
def seed_diversify(spark: SparkSession, sf: str) -> DataFrame:
    from knotwork.operators.retrieve import diversified

    seeds = question_seeds(spark, sf, 40).join(table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    return diversified(seeds, "item_id", "doc_id", "source", 20).select("item_id", "doc_id", "source", "pick_no")


@query(
    f"""WITH {DOC_INDEX}, k AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS word FROM eval_items),
h AS (SELECT item_id, word, max(contains(lower(text), word)) AS hit FROM k JOIN seeds USING (item_id) JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT item_id, count(*) AS n_keywords, count(*) FILTER (hit) AS n_hits, count(*) FILTER (hit) >= ceil(count(*) * 0.5) AS passed FROM h GROUP BY 1"""
)
def keyword_recall(spark: SparkSession, sf: str) -> DataFrame:
    from knotwork.operators.evaluate import keyword_hits

    found = question_seeds(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("item_id", "text")
    return keyword_hits(table(spark, sf, "eval_items"), found, "item_id", "answer", "text")


def first_hit_sql() -> str:
    return f"WITH {DOC_INDEX}, f AS (SELECT item_id, max(score) AS best, count(*) AS n FROM seeds GROUP BY 1)"


@query(
    f"""{first_hit_sql()}, e AS (SELECT question_type || CASE WHEN question_id LIKE '%\\_abs' ESCAPE '\\' THEN '_abs' ELSE '' END AS kind, coalesce(best, 0) >= 0.2 AS correct
 FROM (SELECT DISTINCT item_id, question_id, question_type FROM eval_items) LEFT JOIN f USING (item_id))
SELECT coalesce(kind, 'overall') AS kind, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(100.0 * count(*) FILTER (correct) / count(*), 2) AS accuracy
FROM e GROUP BY ROLLUP (kind)"""
)
def eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    from knotwork.operators.evaluate import accuracy_report

    best = question_seeds(spark, sf).groupBy("item_id").agg(F.max("score").alias("best"))
    items = table(spark, sf, "eval_items").select("item_id", "question_id", "question_type").distinct()
    graded = items.join(best, "item_id", "left").withColumn("correct", F.coalesce("best", F.lit(0.0)) >= 0.2)
    return accuracy_report(graded)


SENTENCES_SQL = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(
    f"""SELECT doc_id, pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (
 SELECT doc_id, list_filter({SENTENCES_SQL.format('text')}, lambda x: trim(x) <> '') AS s FROM documents))"""
)
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


BLANK_SQL = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id, unnest(l) AS para, generate_subscripts(l, 1) AS pi FROM (SELECT doc_id,
  list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '') AS l FROM documents)),
s AS (SELECT doc_id, pi, unnest(l) AS sent, generate_subscripts(l, 1) AS si FROM (SELECT doc_id, pi,
  list_filter({SENTENCES_SQL.format('para')}, lambda x: trim(x) <> '') AS l FROM p WHERE length(para) > 500)),
f AS (SELECT doc_id, pi, si, sent AS chunk, 1 AS n, 1 AS ci, sent AS now FROM s WHERE si = 1
  UNION ALL SELECT s.doc_id, s.pi, s.si, s.sent, CASE WHEN f.n >= 3 OR length(f.now) > 500 THEN 1 ELSE f.n + 1 END,
   CASE WHEN f.n >= 3 OR length(f.now) > 500 THEN f.ci + 1 ELSE f.ci END, CASE WHEN f.n >= 3 OR length(f.now) > 500 THEN s.sent ELSE f.now || ' ' || s.sent END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.pi = f.pi AND s.si = f.si + 1),
c AS (SELECT doc_id, pi, 0 AS ci, {BLANK_SQL.format('para')} AS chunk FROM p WHERE length(para) <= 500
  UNION ALL SELECT doc_id, pi, ci, {BLANK_SQL.format("arg_max(now, si)")} FROM f GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, ci) - 1 AS chunk_no, chunk FROM c"""
)
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query(
    f"""WITH {NODES}, {CONTENT} SELECT node_id, CASE
 WHEN regexp_matches(lower(content), '\\b(is defined as|refers to|is a|is an|means)\\b') AND length(content) < 200 THEN 'definition'
 WHEN regexp_matches(lower(content), '\\b(in \\d{{4}}|on \\w+ \\d{{1,2}}|founded|invented|created|launched|discovered)\\b') THEN 'event'
 WHEN regexp_matches(lower(content), '\\b(\\d+%|\\$[\\d,.]+|[\\d,.]+\\s*(million|billion|thousand))\\b') THEN 'data-point'
 WHEN regexp_matches(lower(content), '\\b(according to|studies show|research suggests|it is believed)\\b') THEN 'claim' ELSE 'fact' END AS chunk_type
FROM t WHERE content IS NOT NULL"""
)
def chunk_classify(spark: SparkSession, sf: str) -> DataFrame:
    nodes = content_nodes(spark, sf, "graph_id", "node_id", "node_type", "content")
    return nodes.where("content is not null").select("node_id", X.chunk_type(F.col("content")).alias("chunk_type"))


ENTITIES_SQL = f"""list_distinct(list_concat(
 regexp_extract_all(content, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1),
 list_filter(list_transform(regexp_split_to_array(content, '\\s+')[2:], lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g')),
   lambda w: length(w) > 2 AND regexp_full_match(w, '[A-Z][a-z]+') AND w NOT IN ({', '.join(f"'{w}'" for w in X.COMMON_CAPITALISED)})),
 regexp_extract_all(content, '\\b(1[0-9]{{3}}|20[0-2][0-9])\\b', 1),
 list_filter(regexp_extract_all(content, '\\b([A-Z]{{2,}})\\b', 1), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in X.COMMON_ACRONYMS)})),
 regexp_extract_all(content, '`([^`]+)`', 1)))"""


@query(f"WITH {NODES}, {CONTENT} SELECT node_id, unnest({ENTITIES_SQL}) AS entity FROM t WHERE content IS NOT NULL")
def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    nodes = content_nodes(spark, sf, "graph_id", "node_id", "node_type", "content")
    return nodes.where("content is not null").select("node_id", F.explode(X.entities(F.col("content"))).alias("entity"))


@query(
    """SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2), regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1))) AS link FROM documents"""
)
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(X.links(F.col("text"))).alias("link"))


@query(
    f"""WITH {NODES}, {CONTENT}, e AS (SELECT node_id, ord, list_distinct(list_transform(entities, lambda x: lower(x))) AS names, graph_id FROM t WHERE len(entities) > 0),
x AS (SELECT graph_id, node_id, ord, names, unnest(names) AS name FROM e),
f AS (SELECT graph_id, name FROM x GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 499), y AS (SELECT x.* FROM x JOIN f USING (graph_id, name)),
p AS (SELECT a.node_id AS node_a, b.node_id AS node_b, any_value(a.names) AS na, any_value(b.names) AS nb FROM y a JOIN y b USING (graph_id, name)
 WHERE (a.ord, a.node_id) < (b.ord, b.node_id) GROUP BY 1, 2)
SELECT node_a, node_b, round(len(list_intersect(na, nb)) / len(list_distinct(list_concat(na, nb))), 6) AS jaccard FROM p
WHERE len(list_intersect(na, nb)) >= 0.2 * len(list_distinct(list_concat(na, nb)))"""
)
def entity_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    from knotwork.operators.reflect import sharing_pairs

    return sharing_pairs(content_nodes(spark, sf, "graph_id", "node_id", "node_type", "ord", "entities"), 0.2)


@query(
    """SELECT file_key, text_hash FROM (SELECT DISTINCT coalesce(title, '') AS file_key, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL)"""
)
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select(F.coalesce("title", F.lit("")).alias("file_key"), X.content_hash(F.col("text")).alias("text_hash")).distinct()


#: Documents from this time on count as newly arrived. Fixed value.
ARRIVAL = "2024-09-01 00:00:00"


@query(
    f"""SELECT min(doc_id) AS doc_id FROM documents WHERE ingested_at >= TIMESTAMP '{ARRIVAL}' AND text IS NOT NULL
 AND text NOT IN (SELECT text FROM documents WHERE ingested_at < TIMESTAMP '{ARRIVAL}' AND text IS NOT NULL) GROUP BY text"""
)
def incremental_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "ingested_at")
    arrival = F.lit(ARRIVAL).cast("timestamp_ntz")
    new, old = docs.where(F.col("ingested_at") >= arrival), docs.where(F.col("ingested_at") < arrival)
    return G.unseen(new.select("doc_id", "text"), old.select("text"), "text").select("doc_id")
