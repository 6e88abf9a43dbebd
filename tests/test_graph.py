"""Graph operators against plain Python on small fixtures."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from knotwork.operators import corrections as C
from knotwork.operators import evaluate as V
from knotwork.operators import graph as G
from knotwork.operators import providers as M
from knotwork.operators import reflect as S
from knotwork.operators import render as N
from knotwork.operators import retrieve as R
from knotwork.operators.components import connected_components

DIRECTED = "graph_id string, edge_id string, from_node string, to_node string, edge_type string, weight double"
UNDIRECTED = "graph_id string, edge_id string, node_a string, node_b string, edge_type string, weight double"


def directed(spark, rows):
    return spark.createDataFrame([("g", f"d{i}", *r) for i, r in enumerate(rows)], DIRECTED)


def undirected(spark, rows):
    return spark.createDataFrame([("g", f"u{i}", *r) for i, r in enumerate(rows)], UNDIRECTED)


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((60, 40), (40, 80), (80, 79)):
        edges = [(i, i + 1) for i in range(79)] if m == 79 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        parent = {x: x for e in edges for x in e}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert got == {x: root(x) for x in parent}
    star = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(500, 501)], "a long, b long")
    got = dict(map(tuple, connected_components(star, floor=20).collect()))
    assert set(got.values()) == {0, 500} and len(got) == 202
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_closure_is_safe_on_cycles(spark):
    edges = directed(spark, [("a", "b", "contains", 1.0), ("b", "c", "contains", 1.0), ("c", "a", "contains", 1.0), ("x", None, "contains", 1.0)])
    roots = spark.createDataFrame([("g", "a"), ("g", "x")], "graph_id string, node_id string")
    assert {tuple(r)[1:] for r in G.closure(edges, roots).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x")}


def test_labels_agree_for_any_number_of_partitions(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", "similar-to", 0.5) for _ in range(60)] + [("n1", None, "x", 0.1)]
    df = undirected(spark, pairs)
    around = {}
    for a, b, *_ in pairs:
        if b and a != b:
            around.setdefault(a, []).append(b)
            around.setdefault(b, []).append(a)
    labels = {x: x for x in around}
    for _ in range(5):
        labels = {x: min(Counter(labels[y] for y in ys).items(), key=lambda e: (-e[1], e[0]))[0] for x, ys in around.items()}
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {r.node_id: r.label for r in G.label_rounds(df.repartition(int(parts)), 5).collect()} == labels
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_traversal_takes_the_best_way(spark):
    one = directed(spark, [("a", "b", "cites", 0.5), ("b", "c", "cites", 1.0), ("c", "d", "cites", 1.0), ("d", "e", "cites", 1.0), ("z", "a", "cites", 1.0), ("a", "b", "blocked", 1.0), ("q", "a", "cites", None)])
    two = undirected(spark, [("a", "c", "similar-to", 0.9), ("a", None, "similar-to", 1.0)])
    one = one.unionByName(one.where("from_node = 'd'").withColumn("graph_id", F.lit("h")).withColumn("to_node", F.lit("y")))
    nodes = spark.createDataFrame([("g", x) for x in "abcdezq"] + [("h", "y")], "graph_id string, node_id string")
    seeds = spark.createDataFrame([("q", "g", "a", 1.0), ("q", "g", "a", 0.5), ("q", "g", "gone", 0.2)], "k string, graph_id string, node_id string, score double")
    got = {r.node_id: round(r.score, 9) for r in R.traverse(seeds, R.neighbours(one, two, nodes, blocked=("blocked",)), "k").collect()}
    assert got == {"a": 1.0, "b": 0.3, "z": 0.3, "c": 0.54, "d": 0.324, "e": 0.1944, "gone": 0.2}


def test_temporal_boundaries(spark):
    rows = [
        ("2024-01-09 00:00:01", 11, 1.0, None, 1.3 * 1.2), ("2024-01-09 00:00:00", 4, 0.5, None, 1.1 * 1.1 * 0.5), ("2024-01-03 00:00:00", 3, 1.0, None, 1.0),
        (None, 10, 1.0, "2024-01-10 00:00:00", 1.1), (None, 0, 1.0, "2024-01-09 23:59:59", 0.3), (None, 0, None, None, 1.0),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, a string, n long, c double, v string")
    t = lambda c: F.col(c).cast("timestamp_ntz")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    got = [r[0] for r in df.orderBy("i").select(R.temporal_factor(t("a"), F.col("n"), F.col("c"), t("v"), now)).collect()]
    assert got == pytest.approx([r[4] for r in rows])


def test_decay(spark):
    df = spark.createDataFrame([(1.0, "2024-01-01"), (1.0, "2024-01-08"), (0.15, "2020-01-01"), (0.9, "2020-01-01"), (0.5, None)], "c double, a string")
    got = [r[0] for r in df.select(S.decayed_confidence(F.col("c"), F.col("a").cast("timestamp_ntz"), F.lit("2024-01-15").cast("timestamp_ntz"))).collect()]
    assert got == pytest.approx([0.93, 1.0, 0.1, 0.45, 0.5])


def test_inference_threshold_and_existing(spark):
    edges = directed(spark, [("a", "b", "causes", 0.6), ("b", "c", "causes", 0.5), ("b", "d", "causes", 0.4), ("b", "a", "causes", 1.0), ("b", "e", "supports", 1.0), ("b", "f", "causes", 1.0), ("a", "f", "cites", 0.1)])
    assert {(r.from_node, r.to_node, r.weight) for r in S.inferred_edges(edges).collect()} == {("a", "c", 0.15)}


def test_duplicates_and_rewriting(spark):
    nodes = spark.createDataFrame([("g", "b", "fact", 2, "same"), ("g", "a", "fact", 1, "same"), ("g", "c", "section", 0, "same"), ("g", "d", "fact", 3, None), ("h", "e", "fact", 9, "same")], "graph_id string, node_id string, node_type string, ord long, content string")
    merged = G.duplicates(nodes)
    assert [tuple(r) for r in merged.collect()] == [("g", "b", "a")]
    moved = G.rewrite_ends(directed(spark, [("a", "b", "x", 1.0), ("b", "c", "x", 1.0), (None, "b", "x", 1.0)]), merged, ("from_node", "to_node"))
    assert {(r.from_node, r.to_node) for r in moved.collect()} == {("a", "c")}


def test_pruning_leaves_no_loose_ends(spark):
    nodes = spark.createDataFrame([("g", x) for x in "abcd"], "graph_id string, node_id string")
    kept = G.pruned_nodes(nodes, directed(spark, [("a", "b", "x", 0.05), ("a", "c", "x", None)]), undirected(spark, [("c", "d", "x", 0.2)]))
    assert {r.node_id for r in kept.collect()} == {"c", "d"}


def test_router_and_parts(spark):
    asked = {
        "Remind me what you said about tea": "single-session-assistant", "How many books did I buy in the past month?": "multi-session", "How many days ago did I run?": "temporal-reasoning",
        "Can you recommend a film?": "single-session-preference", "Where do I currently live?": "knowledge-update", "What is the number of cats?": "multi-session", "What is my cat's name?": "single-session-user",
    }
    df = spark.createDataFrame([(q,) for q in asked] + [(None,)], "q string")
    got = {r.q: r.kind for r in df.select("q", R.question_type(F.col("q")).alias("kind")).collect()}
    assert got == asked | {None: None}
    parts = df.limit(1).select(R.sub_queries(F.lit('How did Alan Turing influence "modern logic" at MIT and elsewhere today?'))).first()[0]
    assert parts[:4] == ['How did Alan Turing influence "modern logic" at MIT and elsewhere today?', "How", "Alan Turing", "modern logic"] and len(parts) == 6


def test_diversified_rounds(spark):
    seeds = spark.createDataFrame([("q", i, s, sc) for i, (s, sc) in enumerate([("a", 0.9), ("a", 0.8), ("a", 0.7), ("b", 0.6), ("c", 0.5)])], "k string, n int, s string, score double")
    got = [r.n for r in R.diversified(seeds, "k", "n", "s", 4).orderBy("pick_no").collect()]
    assert got == [0, 3, 4, 1]


def test_corrections(spark):
    nodes = spark.createDataFrame([("g", x, f"text {x}", ["N"], 0.8, None) for x in "abcd"], "graph_id string, node_id string, content string, entities array<string>, confidence double, valid_until timestamp_ntz")
    changes = spark.createDataFrame([("a", "edit", "Alan Turing lives", "r"), ("b", "delete", None, "r"), ("c", "supersede", "must be new", "r"), (None, "add", "means x", "r"), ("d", "edit", None, "r"), ("zz", "supersede", "x", "r"), ("d", "add", "more", "r")], "node_id string, kind string, content string, reason string")
    got = {r.node_id: r for r in C.corrected_nodes(nodes, changes, "2024-01-01 00:00:00").collect()}
    assert got["a"].entities == ["Alan Turing", "Turing"] and got["a"].confidence == 1.0 and got["b"].confidence == 0.1 and got["c"].confidence == 0.3 and got["c"].valid_until and got["d"].change == "none"
    added = C.added_nodes(nodes, changes)
    assert {(r.content, r.node_type, r.replaces, r.supports) for r in added.collect()} == {("must be new", "preference", "c", None), ("means x", "definition", None, None), ("more", "fact", None, "d")}
    assert {(r.from_node, r.edge_type) for r in C.correction_edges(added).collect()} == {("c", "supersedes"), ("d", "supports")}


def test_miss_buckets_and_yes(spark):
    df = spark.createDataFrame([("multi-session", 3, "4", "five"), ("other", 3, "1", "1"), ("multi-session", 0, None, "1"), (None, 2, "x", "y"), (None, 2, "Yes, it is", "y")], "c string, n int, p string, g string")
    got = df.select(V.miss_bucket(F.col("c"), F.lit("multi-session"), F.col("n"), F.col("p"), F.col("g")).alias("b"), V.said_yes(F.col("p")).alias("y")).collect()
    assert [r.b for r in got] == ["count_error", "routing", "retrieval", "other", "other"] and got[4].y and not got[0].y


def test_models_and_cache(spark):
    class Loud:
        def answer(self, prompts):
            if any("boom" in p for p in prompts):
                raise ValueError
            return [f'ok {{"synthesis": "{p}", "context": "c"}}' for p in prompts]

    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "k string, p string").coalesce(1)
    cache = spark.createDataFrame([("t", 1, None, None)], "task string, version int, hash string, answer string")
    answers, more = M.with_cache(df, "k", "p", cache, "t", 1, Loud)
    assert {r.k for r in answers.collect()} == {"a", "b", "c"} and more.count() == 2
    again, none = M.with_cache(df, "k", "p", cache.unionByName(more), "t", 1, Loud)
    assert again.count() == 3 and none.count() == 0
    assert M.answered(spark.createDataFrame([("a", "boom")], "k string, p string"), "k", "p", Loud).first().answer is None
    nodes = spark.createDataFrame([("g", "a", 0.95)], "graph_id string, node_id string, confidence double")
    got = M.enriched(nodes, answers.withColumnRenamed("k", "node_id")).first()
    assert (got.synthesis, got.source_quality, got.confidence) == ("x", "unknown", 0.98)
    assert len(M.embedded(df, "k", "p").first().embedding) == 64


def test_subgraph_text(spark):
    best = spark.createDataFrame([("q", "g", "b", 0.9, 1), ("q", "g", "a", 0.5, 2), ("q", "g", "c", 0.1, 3)], "q string, graph_id string, node_id string, score double, place int")
    nodes = spark.createDataFrame(
        [("g", "a", "fact", "A", ("S",), {}), ("g", "b", "session-summary", "B", (None,), {"claims": "x || y", "session_id": "s1"}), ("g", "c", "section", "C", (None,), None), ("h", "a", "fact", "elsewhere", ("S",), {})],
        "graph_id string, node_id string, node_type string, content string, source struct<section: string>, metadata map<string, string>",
    )
    one = R.edges_between(best, directed(spark, [("a", "b", "cites", 0.25), ("a", "zz", "cites", 1.0)]), "q", ("from_node", "to_node"))
    text = N.subgraph_texts(best, nodes, one, R.edges_between(best, undirected(spark, []), "q", ("node_a", "node_b")), "q").first().text
    assert "(3 nodes, 1 edges)" in text and "[n1|summary|0.90|session:s1] B" in text and "claims: x | y" in text and "[n2|fact|0.50|src:S] A" in text and "n2 -[cites:0.3]-> n1" in text
    assert "] C" not in text and "elsewhere" not in text


def test_nested_sections(spark):
    rows = [("d", "document", 0, "D", None, {}), ("s1", "section", 1, "A", "A", {"depth": "1"}), ("s2", "section", 2, "B", "B", {"depth": "3"}), ("s3", "section", 3, "C", "C", {"depth": "2"}), ("s4", "section", 4, "E", "E", None), ("n", "fact", 5, "x", "B", {})]
    nodes = spark.createDataFrame([("g", n, t, o, c, ("f", s), m) for n, t, o, c, s, m in rows], "graph_id string, node_id string, node_type string, ord long, content string, source struct<file: string, section: string>, metadata map<string, string>")
    assert {(r.from_node, r.to_node) for r in G.contains_edges(nodes).collect()} == {("d", "s1"), ("s1", "s2"), ("s1", "s3"), ("d", "s4"), ("s2", "n")}


def test_labels_settle_and_make_community_nodes(spark):
    pairs = [(a, b, "similar-to", 0.5) for x in ("abcd", "wxyz") for a in x for b in x if a < b] + [("a", "zz", "similar-to", 0.5)]
    nodes = spark.createDataFrame([("g", n, i, f"text {n}" + "!" * i, ["Ada", n.upper()]) for i, n in enumerate("abcdwxyz")], "graph_id string, node_id string, ord long, content string, entities array<string>")
    labels = G.label_rounds(undirected(spark, pairs), 10, nodes)
    got = {r.node_id: (r.label, r.settled) for r in labels.collect()}
    assert len(got) == 8 and all(s for _, s in got.values()) and len({got[n][0] for n in "abcd"}) == 1 and got["w"][0] != got["a"][0]
    made, edges = G.community_nodes(labels, nodes)
    first = {r.label: r for r in made.collect()}[got["a"][0]]
    assert first.content == "[Cluster: Ada, A, B, C, D] text a | text b! | text c!!" and first.n_members == 4
    assert edges.count() == 8 and {r.weight for r in edges.collect()} == {0.7}


def test_session_summary_nodes(spark):
    made = spark.createDataFrame([("g", f"m{i}", i, "message", f"Ada said {i}. More", ("chat:1",), {"session_date": "2024-01-01"}) for i in range(3)] + [("g", "f", 9, "fact", "no", ("x",), {})], "graph_id string, node_id string, ord long, node_type string, content string, source struct<file: string>, metadata map<string, string>")
    nodes, edges = M.session_nodes(made, "2025-01-01 00:00:00", M.FirstSentences)
    row = nodes.first()
    assert nodes.count() == 1 and row.node_type == "session-summary" and row.metadata == {"session_id": "chat:1", "session_date": "2024-01-01", "turn_count": "3"} and row.content.startswith("Ada said 0")
    assert {(r.from_node, r.to_node, r.weight) for r in edges.collect()} == {(row.node_id, f"m{i}", 0.7) for i in range(3)}


def test_summary_policy(spark):
    seeds = spark.createDataFrame([("session-summary", 0.5, True), ("session-summary", 0.5, False), ("session-summary", 0.5, None), ("fact", 0.5, True), (None, 0.5, False)], "node_type string, score double, summaries boolean")
    assert sorted((r.node_type or "", r.score) for r in R.summary_policy(seeds).collect()) == [("", 0.5), ("fact", 0.5), ("session-summary", 0.5), ("session-summary", 0.65)]
