"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

SPEAKER = """CASE lower({0}) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'system' THEN 'system' END"""
MARK = "(?i)^[\\s*_>#-]*(user|human|assistant|ai|bot|model|system)[\\s*_]*:[\\s*_]*"

P1 = f"""
WITH raw AS (SELECT DISTINCT node_id, ord, content, source.file AS file, source.section AS section, source.char_offset AS pos, metadata FROM nodes WHERE node_type = 'message' AND source.file IS NOT NULL),
k AS (SELECT *, CASE WHEN starts_with(file, 'conversation:') THEN 'transcript' WHEN starts_with(file, 'slack:') THEN 'channel' WHEN starts_with(file, 'lme:') THEN 'turns' ELSE 'export' END AS kind,
  coalesce(try_cast(metadata['turn'] AS BIGINT), try_cast(regexp_extract(section, '\\d+', 0) AS BIGINT)) AS turn FROM raw),
s AS (SELECT *, CASE kind WHEN 'channel' THEN CASE WHEN metadata['subtype'] IS NOT NULL THEN 'system' WHEN metadata['bot_id'] IS NOT NULL THEN 'assistant' WHEN metadata['user'] IS NOT NULL THEN 'user' END
   WHEN 'transcript' THEN {SPEAKER.format(f"regexp_extract(content, '{MARK}', 1)")}
   WHEN 'turns' THEN {SPEAKER.format("coalesce(nullif(regexp_extract(section, '(?i)^[\\s]*(user|assistant|system)\\b', 1), ''), metadata['role'])")} ELSE {SPEAKER.format("metadata['role']")} END AS speaker,
  regexp_replace(coalesce(CASE WHEN kind = 'transcript' THEN regexp_replace(content, '{MARK}', '') ELSE content END, ''), '^\\s+|\\s+$', '', 'g') AS text FROM k),
p AS (SELECT *, CASE kind WHEN 'channel' THEN try_cast(replace(metadata['ts'], '.', '') AS BIGINT) WHEN 'transcript' THEN pos WHEN 'turns' THEN turn * 2 + (CASE WHEN speaker = 'assistant' THEN 1 ELSE 0 END) ELSE try_cast(metadata['seq'] AS BIGINT) END AS place,
  CASE kind WHEN 'turns' THEN turn WHEN 'export' THEN try_cast(metadata['seq'] AS BIGINT) END AS number FROM s),
g AS (SELECT file FROM p WHERE number IS NOT NULL GROUP BY 1 HAVING max(number) - min(number) + 1 <> count(DISTINCT number)),
m AS (SELECT file, place, arg_min(node_id, ord) AS node_id, arg_min(coalesce(speaker, '?'), ord) AS speaker, count(DISTINCT text) AS texts, bool_and(regexp_matches(text, '[\\p{{L}}\\p{{N}}]')) AS says FROM p WHERE speaker IS DISTINCT FROM 'system' GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY place) AS place_no FROM m),
ok AS (SELECT file FROM n GROUP BY 1 HAVING bool_and(texts = 1 AND says AND place IS NOT NULL AND speaker = CASE WHEN place_no % 2 = 1 THEN 'user' ELSE 'assistant' END) AND count(*) % 2 = 0)
SELECT file, place_no::INT AS place_no, speaker, node_id FROM n WHERE file IN (SELECT file FROM ok) AND file NOT IN (SELECT file FROM g)"""

P2 = """SELECT DISTINCT node_id, CASE WHEN list_max(list_transform(regexp_split_to_array(content, '[ \\t\\n\\r。]'), lambda x: length(x))) > 1200 THEN 1 ELSE 0 END AS forced FROM nodes WHERE length(content) > 1200"""

P2_REBUILT = "SELECT DISTINCT node_id, md5(content) AS content_md5, length(content)::INT AS n_chars, true AS all_fit, true AS all_overlap FROM nodes WHERE length(content) > 1200"

WORDS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

P5 = f"""
WITH t AS (SELECT node_id, {WORDS.format('any_value(content)')} AS w FROM nodes WHERE node_type IS NULL OR node_type NOT IN ('document', 'section', 'message') GROUP BY node_id),
s AS (SELECT DISTINCT node_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS sh FROM t WHERE len(w) >= 20),
z AS (SELECT node_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.node_id AS node_a, b.node_id AS node_b, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.node_id < b.node_id GROUP BY 1, 2)
SELECT node_a, node_b FROM c JOIN z x ON x.node_id = node_a JOIN z y ON y.node_id = node_b WHERE 2 * k >= x.n + y.n - k"""

RUNS = "list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))"

P7 = f"""
WITH i AS (SELECT item_id, {WORDS.format('passage')} AS w FROM eval_items UNION ALL SELECT item_id, {WORDS.format('question')} FROM eval_items),
p AS (SELECT DISTINCT item_id, unnest({RUNS}) AS run FROM i WHERE len(w) >= 12), d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
r AS (SELECT doc_id, unnest({RUNS}) AS run FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM r JOIN p USING (run)"""

SQL = {"p1_found": P1, "p2_found": P2, "p2_rebuilt": P2_REBUILT, "p5_found": P5, "p7_found": P7}
