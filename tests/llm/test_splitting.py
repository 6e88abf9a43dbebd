"""Splitting: limits, exact overlap, natural cuts, forced cuts and odd inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm.splitting import cuts, split_texts

TEXT = st.lists(st.sampled_from(["word", "a", "x" * 130, "Ende. ", "\n\n", "\n# Head\n", " ", "。", "\t", "é", "𝒳"]), max_size=120).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.sampled_from([(60, 10), (120, 12), (100, 0)]))
def test_pieces_cover_the_text(text, size):
    limit, overlap = size
    pieces = cuts(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert c == b - overlap and d > b and c > a
    assert all(b - a <= limit for a, b, _ in pieces)
    for a, b, at in pieces[:-1]:
        if at == "word":
            assert re.match(r"[ \t\r\n]", text[b]) or re.search(r"[ \t\r\n。]$", text[:b])


def test_strong_pauses_come_first():
    text = "# One\n" + "a b c. " * 10 + "\n# Two\n" + "d e f. " * 10
    pieces = cuts(text, 100, 10)
    assert pieces[0][2] == "section" and text[pieces[0][1] :].startswith("# Two")


def frame(spark, rows):
    return spark.createDataFrame(rows, "node_id string, content string, section string, key string, piece int, forced string, text string")


def test_nulls_ties_repeats_and_clashing_columns(spark):
    long = "word " * 400
    run = "y" * 1300
    rows = [("a", long, "S", "k", 1, "f", "t"), ("a", long, "S", "k", 1, "f", "t"), ("b", run, None, "k", 1, "f", "t"), ("c", None, "S", "k", 1, "f", "t"), ("d", "", "S", "k", 1, "f", "t"), ("e", "z" * 1200, "S", "k", 1, "f", "t")]
    got = split_texts(frame(spark, rows), 1200, 120).collect()
    assert {r.node_id for r in got} == {"a", "b"}
    assert {(r.node_id, r.forced) for r in got} == {("a", 0), ("b", 1)}
    assert [r.piece_no for r in sorted((r for r in got if r.node_id == "a"), key=lambda r: r.piece_no)] == [1, 2]
    assert {r.section for r in got if r.node_id == "b"} == {None}
    assert all(len(r.piece) <= 1200 and r.piece == (long if r.node_id == "a" else run)[r.start : r.end] for r in got)


def test_empty_table_and_very_long_text(spark):
    assert split_texts(frame(spark, [])).count() == 0
    text = "Satz eins. " * 100_000
    got = split_texts(frame(spark, [("a", text, None, "k", 1, "f", "t")])).orderBy("piece_no").collect()
    assert got[-1].end == len(text) and all(x.end - y.start == 120 for x, y in zip(got, got[1:]))


def test_against_brute_force(spark, small):
    from knotwork.llm.queries import p2_found

    nodes = spark.read.parquet(f"{small}/nodes.parquet").select("node_id", "content").collect()
    want = {(r.node_id, int(bool(re.search(r"[^ \t\n\r。]{1201}", r.content)))) for r in nodes if r.content and len(r.content) > 1200}
    assert {tuple(r) for r in p2_found(spark, small).collect()} == want
