"""Queries that parse the texts of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.plans.registry import query
from knotwork.sources import conversations as V
from knotwork.sources import texts as T
from knotwork.session import table

BLANK = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def texts_of(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return table(spark, sf, "documents").where((F.col("doc_format") == kind) & F.col("text").isNotNull()).select("doc_id", "text")


@query(
    f"""WITH l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_format = 'markdown' AND text IS NOT NULL)),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}[\\t\\x0B\\f\\r ]+.') AS is_head FROM l), s AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec_no FROM h),
c AS (SELECT doc_id, sec_no, coalesce(length(max(CASE WHEN is_head THEN regexp_extract(line, '^(#+)', 1) END)), 1) AS depth, coalesce(max(CASE WHEN is_head THEN {BLANK.format("regexp_extract(line, '^#+(.*)$', 1)")} END), 'Content') AS title,
 coalesce({BLANK.format("string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY pos)")}, '') AS content FROM s GROUP BY 1, 2)
SELECT doc_id, sec_no::INT AS sec_no, (SELECT max(p.sec_no) FROM c p WHERE p.doc_id = c.doc_id AND p.sec_no < c.sec_no AND p.sec_no > 0 AND p.depth < c.depth)::INT AS parent_no, depth, title, content FROM c WHERE sec_no > 0 OR content <> ''"""
)
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    return T.markdown_sections(texts_of(spark, sf, "markdown"), "doc_id", "text")


@query(
    f"""WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(13), ''), '\\n[ \\t]*\\n'), lambda x: array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda y: {BLANK.format('y')}),
  lambda y: y <> '' AND NOT regexp_full_match(y, '[0-9]+') AND NOT contains(y, '-->') AND y <> 'WEBVTT'), ' ')), lambda x: x <> '') AS l FROM documents WHERE doc_format = 'subtitle' AND text IS NOT NULL),
u AS (SELECT doc_id, len(l) AS n, unnest(l) AS block, generate_subscripts(l, 1) - 1 AS i FROM b)
SELECT doc_id, (i // 10)::INT AS sec_no, 'Transcript ' || min(i) + 1 || '-' || max(i) + 1 AS title, string_agg(block, ' ' ORDER BY i) AS content FROM u GROUP BY doc_id, i // 10"""
)
def subtitle_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts_of(spark, sf, "subtitle").select("doc_id", F.posexplode(T.subtitle_sections(F.col("text"))).alias("sec_no", "s"))
    return rows.select("doc_id", "sec_no", "s.title", "s.content")


CHAT_SQL = f"""b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?i)\\n\\n((?:Human|Assistant|User|System):)', chr(1) || '\\1', 'g'), chr(1)), lambda x: {BLANK.format('x')}),
  lambda x: regexp_matches(x, '(?i)^(human|user|assistant|system):')) AS l FROM documents WHERE doc_format = 'transcript' AND (contains(text, 'Human:') OR contains(text, 'Assistant:') OR contains(text, '> '))),
r AS (SELECT doc_id, {BLANK.format('x')} AS text, i, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id,
  list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda x: regexp_replace(x, '\\s+', '', 'g') <> '') AS l FROM documents WHERE doc_format = 'transcript' AND NOT (contains(text, 'Human:') OR contains(text, 'Assistant:') OR contains(text, '> '))))),
m AS (SELECT doc_id, i AS pos, CASE lower(regexp_extract(x, '(?i)^(human|user|assistant|system):', 1)) WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS role,
  {BLANK.format("regexp_replace(x, '(?i)^(human|user|assistant|system):\\s*', '')")} AS text FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM b) UNION ALL SELECT doc_id, i, role, text FROM r)"""


@query(f"WITH {CHAT_SQL} SELECT doc_id, pos::INT AS pos, role, text FROM m")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    return V.parse_chats(texts_of(spark, sf, "transcript"), "doc_id", "text").drop("format")


@query(
    f"""WITH {CHAT_SQL} SELECT doc_id, i::INT AS sec_no, CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ' (turn ' || (i // 2 + 1) || ')' AS title, text AS content
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM m WHERE role <> 'system')"""
)
def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    return V.turn_sections(V.parse_chats(texts_of(spark, sf, "transcript"), "doc_id", "text"), "doc_id")


@query(
    """WITH x AS (SELECT item_id, regexp_extract(question_date, '([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})', 0) AS d FROM eval_items)
SELECT DISTINCT item_id, CASE WHEN d <> '' THEN strftime(replace(d, '/', '-')::DATE, '%Y-%m-%d (%a)') END AS day FROM x"""
)
def question_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", X.day_tag(F.col("question_date")).alias("day")).distinct()
