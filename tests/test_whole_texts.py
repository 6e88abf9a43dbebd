"""Long sessions and documents are read to their end."""

from knotwork.operators import providers as M
from knotwork.plans import insight_queries as Q


def test_prompts_hold_the_whole_session(spark):
    said = [f"m{i} " + "x" * 40 for i in range(50)] + ["y" * 137 + "END", ""]
    rows = [("long", i, t) for i, t in enumerate(said)] + [("short", 1, "b"), ("short", 0, "a"), ("short", 2, None), (None, 0, "c"), ("same", 0, "p"), ("same", 0, "q")]
    df = spark.createDataFrame(rows, "s string, n int, t string").repartition(4)
    got = {}
    for r in M.session_prompts(df, ["s"], "t", "n", 120).orderBy("s", "part_no").collect():
        got.setdefault(r.s, []).append(r.prompt.split("\n\n", 1)[1])
    assert max(len(p) for p in got["long"]) <= 120 and len(got["long"]) > 10
    assert "".join(got["long"]).replace("\n", "") == "".join(said)
    assert got["short"] == ["a\nb"] and got[None] == ["c"] and sorted(got["same"][0].split("\n")) == ["p", "q"]
    assert [r.part_no for r in M.session_prompts(df, ["s"], "t", "n").where("s = 'long'").collect()] == [0]


def test_answers_are_combined_by_session(spark):
    parts = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("b", 0, "x"), ("b", 1, None)], "k string, part_no int, summary string")
    assert {tuple(r) for r in M.session_answers(parts, ["k"], "part_no", "summary").collect()} == {("a", "one two"), ("b", None)}


def test_misses_read_the_whole_document(spark, monkeypatch):
    question = "How many books did I buy in total?"
    tables = {
        "eval_items": spark.createDataFrame([("i", question, "multi-session", "7"), ("j", question, "multi-session", "7")], "item_id string, question string, question_type string, answer string"),
        "documents": spark.createDataFrame([("far", "word " * 60 + "and 4 books"), ("none", "word " * 60)], "doc_id string, text string"),
    }
    monkeypatch.setattr(Q, "table", lambda spark, sf, name: tables[name])
    monkeypatch.setattr(Q, "question_seeds", lambda *_: spark.createDataFrame([("i", "far", 1), ("j", "none", 1)], "item_id string, doc_id string, seed_no int"))
    assert {(r.item_id, r.bucket) for r in Q.miss_buckets(spark, "").collect()} == {("i", "count_error"), ("j", "other")}
