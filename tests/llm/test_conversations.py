"""Rebuilding conversations: every import format, every reason to drop one, and hot files."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from knotwork.llm.conversations import rebuild_conversations

SCHEMA = (
    "node_id string, ord long, node_type string, source struct<file:string,char_offset:long,line:int,section:string>, content string, metadata map<string,string>, "
    "created_at timestamp_ntz, last_accessed_at timestamp_ntz, access_count long, file string, place int, slice string, n int, version int"
)


def rows(spark, messages):
    """messages: (node_id, file, content, metadata, section, offset[, access_count])."""
    from datetime import datetime

    t = datetime(2024, 1, 1)
    out = []
    for i, (node, file, content, meta, section, offset, *seen) in enumerate(messages):
        out.append((node, i, "message", (file, offset, None, section), content, meta, t, None, seen[0] if seen else 0, "clash", 1, "clash", 1, 1))
    return spark.createDataFrame(out, SCHEMA)


def kept(df, **options):
    return {tuple(r) for r in rebuild_conversations(df, **options).collect()}


def test_transcript_order_marks_and_system(spark):
    df = rows(spark, [
        ("b", "conversation:1.md", "**Assistant:** yes", {}, None, 20), ("a", "conversation:1.md", "\nHuman: really?", {}, None, 10), ("s", "conversation:1.md", "System: be kind", {}, None, 0),
    ])
    assert kept(df) == {("conversation:1.md", 1, "user", "a"), ("conversation:1.md", 2, "assistant", "b")}


def test_exports_channels_and_turns(spark):
    df = rows(spark, [
        ("a", "chatgpt-export/1.json", "hi", {"role": "Human", "seq": "2"}, None, 0), ("b", "chatgpt-export/1.json", "ho", {"role": "model", "seq": "3"}, None, 0),
        ("c", "slack:x/1", "late", {"bot_id": "B", "ts": "1700000002.000001"}, None, 0), ("d", "slack:x/1", "early", {"user": "U", "ts": "1700000001.000009"}, None, 0),
        ("e", "slack:x/1", "joined", {"subtype": "channel_join", "ts": "1700000000.0"}, None, 0),
        ("f", "lme:q:1", "2", {}, "Assistant (turn 1)", 0), ("g", "lme:q:1", "1", {}, "USER - turn 1", 0), ("h", "lme:q:1", "3", {"turn": "2", "role": "user"}, None, 0), ("i", "lme:q:1", "4", {"turn": "2", "role": "assistant"}, None, 0),
    ])
    got = kept(df)
    assert {(f, n, x) for f, n, _, x in got} == {
        ("chatgpt-export/1.json", 1, "a"), ("chatgpt-export/1.json", 2, "b"), ("slack:x/1", 1, "d"), ("slack:x/1", 2, "c"), ("lme:q:1", 1, "g"), ("lme:q:1", 2, "f"), ("lme:q:1", 3, "h"), ("lme:q:1", 4, "i"),
    }


@pytest.mark.parametrize(
    "second",
    [
        ("b", "?!", {"role": "assistant", "seq": "2"}), ("b", None, {"role": "assistant", "seq": "2"}), ("b", "x", {"role": "narrator", "seq": "2"}), ("b", "x", {"role": "user", "seq": "2"}),
        ("b", "x", {"role": "assistant", "seq": "3"}), ("b", "x", {"role": "assistant"}), ("b", "", {"role": "assistant", "seq": "2"}),
    ],
)
def test_broken_conversations_are_dropped(spark, second):
    df = rows(spark, [("a", "chatgpt-export/1", "hi", {"role": "user", "seq": "1"}, None, 0), (second[0], "chatgpt-export/1", second[1], second[2], None, 0)])
    assert kept(df) == set()


def test_unanswered_and_two_texts_are_dropped(spark):
    one = rows(spark, [("a", "chatgpt-export/1", "hi", {"role": "user", "seq": "1"}, None, 0)])
    assert kept(one) == set()
    two = rows(spark, [
        ("a", "chatgpt-export/1", "hi", {"role": "user", "seq": "1"}, None, 0), ("b", "chatgpt-export/1", "ho", {"role": "assistant", "seq": "2"}, None, 0), ("c", "chatgpt-export/1", "other", {"role": "assistant", "seq": "2"}, None, 0),
    ])
    assert kept(two) == set()


def test_retries_and_redeliveries_fold(spark):
    df = rows(spark, [
        ("a", "conversation:1", "Human: hi", {}, None, 0), ("a", "conversation:1", "Human: hi", {}, None, 0, 7), ("z", "conversation:1", "user:  hi ", {}, None, 0), ("b", "conversation:1", "Assistant: ho", {}, None, 9),
    ])
    assert kept(df) == {("conversation:1", 1, "user", "a"), ("conversation:1", 2, "assistant", "b")}


def test_system_numbers_close_gaps_and_null_files(spark):
    df = rows(spark, [
        ("a", "chatgpt-export/1", "hi", {"role": "user", "seq": "1"}, None, 0), ("s", "chatgpt-export/1", "sys", {"role": "system", "seq": "2"}, None, 0), ("b", "chatgpt-export/1", "ho", {"role": "assistant", "seq": "3"}, None, 0),
        ("n", None, "lost", {"role": "user", "seq": "1"}, None, 0), ("m", "chatgpt-export/2", "lost", None, None, 0),
    ])
    assert {x[3] for x in kept(df)} == {"a", "b"}


def test_hot_file_is_ranked_in_slices(spark):
    n = 400
    messages = [(f"m{i:04}", "conversation:hot", f"{'Human' if i % 2 == 0 else 'Assistant'}: word {i}", {}, None, i * 13 if i < 300 else 4000 + i) for i in range(n)]
    messages += [("x", "conversation:cold", "Human: a", {}, None, 1), ("y", "conversation:cold", "Assistant: b", {}, None, 2)]
    got = kept(rows(spark, messages), slice_rows=25)
    assert {(p, m) for f, p, _, m in got if f == "conversation:hot"} == {(i + 1, f"m{i:04}") for i in range(n)}
    assert len(got) == n + 2


def test_empty_table_and_long_text(spark):
    assert kept(rows(spark, [])) == set()
    df = rows(spark, [("a", "conversation:1", "Human: " + "long text " * 200_000, {}, None, 0), ("b", "conversation:1", "Assistant: ok", {}, None, 5)])
    assert len(kept(df)) == 2


def test_against_brute_force(spark, small):
    nodes = spark.read.parquet(f"{small}/nodes.parquet")
    said = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "system": "system"}
    files, seen = defaultdict(list), set()
    for r in nodes.where("node_type = 'message'").select("node_id", "ord", "content", "source", "metadata").collect():
        if r.node_id in seen:
            continue
        seen.add(r.node_id)
        text, number, meta, file, section = r.content or "", None, r.metadata or {}, r.source.file, r.source.section
        if file.startswith("conversation:"):
            m = re.match(r"[\s*]*(\w+)[\s*]*:[\s*]*", text)
            who, place = said.get(m[1].lower()) if m else None, r.source.char_offset
            text = text[m.end() :] if who else text
        elif file.startswith("slack:"):
            who, place = "system" if meta.get("subtype") else "assistant" if meta.get("bot_id") else "user" if meta.get("user") else None, meta["ts"]
        elif file.startswith("lme:"):
            m, d = re.match(r"(?i)\s*(user|assistant|system)", section or ""), re.search(r"\d+", section or "")
            who = m[1].lower() if m else None if section else said.get(meta.get("role", "").lower())
            number = int(d[0]) if d else int(meta["turn"]) if "turn" in meta else None
            place = (number, who != "user")
        else:
            who, number = said.get(meta.get("role", "").lower()), int(meta["seq"])
            place = number
        files[file].append((place, r.ord, r.node_id, who, text.strip(), number))
    want = set()
    for file, rows_ in files.items():
        numbers = {x[5] for x in rows_} - {None}
        by = defaultdict(list)
        for x in rows_:
            if x[3] != "system":
                by[x[0]].append(x)
        whole = by and not (numbers and max(numbers) - min(numbers) + 1 != len(numbers)) and all(len({x[4] for x in y}) == 1 for y in by.values())
        turns = [min(by[k], key=lambda x: x[1]) for k in sorted(by)] if whole else []
        if turns and len(turns) % 2 == 0 and all(re.search(r"[^\W_]", x[4]) and x[3] == ("user", "assistant")[i % 2] for i, x in enumerate(turns)):
            want |= {(file, i + 1, x[3], x[2]) for i, x in enumerate(turns)}
    assert want and kept(nodes.withColumn("place", F.lit(0))) == want
