"""Alike pairs are found whatever the number of texts that share their terms or names."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from knotwork.operators import graph as G
from knotwork.operators.reflect import contradictions, discoveries, inferred_edges, sharing_pairs
from knotwork.operators.spread import join_sliced, met_in_blocks, numbered
from knotwork.session import materialise

NODE = "graph_id string, node_id string, node_type string, ord long, content string, entities array<string>"


def nodes_of(spark, n=60):
    rng = random.Random(7)
    words, names = ["alpha", "bravo", "cedar", "delta", "ember", "flint", "grove"], ["Ada", "Bob", "Cy", "Di", "Ed"]
    return spark.createDataFrame([("g", f"n{i:02}", "fact", i, " ".join(rng.sample(words, 3)), rng.sample(names, rng.randrange(4))) for i in range(n)], NODE)


def test_common_terms_lose_no_pair(spark):
    nodes = nodes_of(spark)
    rows = nodes.collect()
    n = len(rows)
    terms = {r.node_id: Counter(r.content.split()) for r in rows}
    df = Counter(t for c in terms.values() for t in c)
    weigh = {k: {t: f * (math.log((n + 1) / (df[t] + 1)) + 1) for t, f in c.items()} for k, c in terms.items()}
    length = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in weigh.items()}
    want = {}
    for a in rows:
        for b in rows:
            if a.ord < b.ord:
                x, y = weigh[a.node_id], weigh[b.node_id]
                cosine = round(sum(w * y.get(t, 0) for t, w in x.items()) / length[a.node_id] / length[b.node_id], 6)
                both = {*a.entities} | {*b.entities}
                share = round(len({*a.entities} & {*b.entities}) / len(both), 6) if both else 0
                if cosine >= 0.5:
                    want[a.node_id, b.node_id] = ("similar-to", cosine)
                elif share >= 0.2 and cosine > 0:
                    want[a.node_id, b.node_id] = ("shares-entity", share)
    for early in (0.05, 0.2, 0.4):
        got = {(r.node_a, r.node_b): (r.edge_type, r.weight) for r in G.similarity_edges(nodes, per_node=100, similar=0.5, early=early).collect()}
        assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_pairs_that_are_not_among_the_best_stay_in_their_task(spark, monkeypatch):
    n, written = 400, []
    nodes = spark.createDataFrame([("g", f"n{i:03}", "fact", i, "alpha bravo cedar", ["Ada"]) for i in range(n)], NODE)
    monkeypatch.setattr(G, "materialise", lambda df, what="step": (made := materialise(df, what), written.append(made.count()))[0])
    got = {(r.node_a, r.node_b, r.edge_type, r.weight) for r in G.similarity_edges(nodes).collect()}
    assert got == {(f"n{i:03}", f"n{j:03}", "similar-to", 1.0) for j in range(11) for i in range(j)}
    assert max(written) <= 10 * n * 6  # of 79,800 pairs


def test_slices_of_a_graph_give_the_same_pairs(spark):
    few = nodes_of(spark, 90).drop("graph_id").crossJoin(spark.createDataFrame([(f"g{i}",) for i in range(8)], "graph_id string")).select("graph_id", "node_id", "node_type", "ord", "content", "entities")
    none = spark.createDataFrame([("g1", "z1", "fact", 900, "alpha zebra", ["Ada", None]), ("g1", "z2", "fact", 901, None, ["ADA"]), ("h", "z3", "fact", 1, "", None), (None, "z4", "fact", 1, "alpha", ["Ada"])], NODE)
    nodes = few.unionByName(none).repartition(3)
    one, many = (sorted(map(tuple, G.similarity_edges(nodes, per_node=4, similar=0.6, most_texts=m).collect())) for m in (1000, 20))
    assert one == many and {r[3] for r in one} == {"similar-to", "shares-entity"} and not {"z2", "z3", "z4"} & {v for r in one for v in r[1:3]}
    assert G.similarity_edges(nodes.limit(0)).count() == 0


def test_common_names_lose_no_pair(spark):
    nodes = nodes_of(spark, 30)
    crowd = nodes.unionByName(spark.createDataFrame([("h", f"m{i:03}", "fact", i, "x", ["Same"]) for i in range(510)], NODE))
    rows = [r for r in nodes.collect() if r.entities]
    want = {(a.node_id, b.node_id) for a in rows for b in rows if a.ord < b.ord and len({*a.entities} & {*b.entities}) >= 0.4 * len({*a.entities} | {*b.entities})}
    got = sharing_pairs(crowd, 0.4).collect()
    assert {(r.node_a, r.node_b) for r in got if r.node_a[0] == "n"} == want and len(got) == len(want) + 510 * 509 // 2


def test_blocks_meet_once(spark):
    met = met_in_blocks(spark.createDataFrame([("k", i) for i in range(40)], "k string, item long"), ["k"], 7).collect()
    assert len(met) == len({(r.x, r.y) for r in met}) == 40 * 39 // 2


def test_contradictions_over_frequent_names(spark):
    long = "The archive at Norbriev keeps many old maps of the northern coast and its harbours, open every day"
    other = "Restoration work was never finished although disputed budgets reached parliament several times during winter sessions"
    names = ["Norbriev", "Archive Hall", "Ada"]
    rows = [("g", "a", "fact", 1, long, names), ("g", "b", "claim", 2, other, names), ("g", "c", "fact", 3, long, names), ("h", "d", "claim", 4, other, names), ("g", "e", "fact", 5, other, ["Norbriev"]), ("g", "f", "fact", 6, None, names)]
    rows += [("g", f"x{i}", "fact", 10 + i, "short text about nothing much that goes on for fifty characters", ["Norbriev", f"n{i}"]) for i in range(40)]
    got = {tuple(r)[1:] for r in contradictions(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {("a", "b", 2), ("b", "c", 2)}


def test_discoveries_use_all_nodes(spark):
    node = "graph_id string, node_id string, node_type string, ord long, entities array<string>, source struct<file: string>"
    rows = [("g", f"n{i:03}", "fact", i, ["Common"], ("wiki:a",)) for i in range(150)] + [("g", "y", "fact", 900, ["Common", "Ada", "Bob"], ("wiki:a",)), ("g", "z", "fact", 901, ["common", "ADA", "Bob"], ("notes:b",)), ("g", "w", "fact", 902, ["Ada", "Bob"], ("wiki:c",)), ("h", "v", "fact", 1, ["Ada", "Bob"], ("x:c",))]
    nodes = spark.createDataFrame(rows, node)
    none = spark.createDataFrame([("g", "z", "w")], "graph_id string, node_a string, node_b string")
    assert {tuple(r) for r in discoveries(nodes, none).collect()} == {("g", "y", "z", 3, 0.6)}
    assert discoveries(nodes, none, per_domain=100).count() == 0


def test_hot_middles_meet_in_slices(spark):
    rows = [("g", f"a{i}", "m", "causes", 0.9) for i in range(30)] + [("g", "m", f"b{i}", "causes", 0.8) for i in range(30)] + [("g", "q", "r", "causes", 0.9), ("g", "r", "s", "causes", 0.3)]
    edges = spark.createDataFrame(rows, "graph_id string, from_node string, to_node string, edge_type string, weight double")
    assert inferred_edges(edges, most=2000).count() == 900
    left, right = edges.select("from_node", F.col("to_node").alias("k")), edges.select(F.col("from_node").alias("k"), "to_node")
    assert sorted(map(tuple, join_sliced(left, right, ["k"], 4, floor=10).collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_rows_are_numbered_over_all_partitions(spark):
    df = spark.range(1000, numPartitions=7).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert [(r.k, r.n) for r in numbered(df, ["k"], "n").orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_links_cite_titles_of_their_graph(spark):
    rows = [
        ("g", "d", "document", 1, "Deep_sea Rovers"), ("g", "d2", "section", 2, "deep_sea rovers"), ("h", "e", "document", 1, "Other"), ("g", "s", "section", 3, "Tide table"),
        ("g", "a", "fact", 4, "see [[tide_TABLE]] and [[Tide table]]"), ("g", "b", "fact", 5, "a [map](tide_table) of [[Other]]"), ("g", "c", None, 6, None), ("g", "f", "fact", 7, ""),
    ]
    nodes = spark.createDataFrame(rows, "graph_id string, node_id string, node_type string, ord long, content string")
    assert {tuple(r) for r in G.cites_edges(nodes).collect()} == {("g", "a", "s", "cites", 0.7), ("g", "b", "s", "cites", 0.7)}
    assert G.cites_edges(nodes.limit(0)).count() == 0


def test_definitions_lead_to_texts_that_use_the_term(spark):
    rows = [
        ("g", "x", "definition", "Tide gauge is defined as a tool"), ("g", "a", "fact", "The TIDE GAUGE broke"), ("g", "b", "fact", "tide and gauge apart"), ("g", "c", "fact", "tide gauges"),
        ("h", "d", "fact", "a tide gauge elsewhere"), ("g", "e", "fact", None), ("g", "y", "definition", None), ("g", "z", "definition", "no sign of a term"),
    ]
    nodes = spark.createDataFrame(rows, "graph_id string, node_id string, node_type string, content string")
    assert {tuple(r) for r in G.defines_edges(nodes).collect()} == {("g", "x", "a", "defines", 0.6)}
    assert G.defines_edges(nodes.limit(0)).count() == 0


def test_only_words_that_a_term_needs_leave_the_scan_with_their_text(spark):
    rows = [("g", f"n{i}", "fact", f"word{i} tide gauge{i % 7} level{i % 5}") for i in range(2000)] + [("g", f"d{i}", "definition", f"Tide gauge{i} is defined as a tool") for i in range(7)]
    nodes = spark.createDataFrame(rows, "graph_id string, node_id string, node_type string, content string")
    got = {(r.from_node, r.to_node) for r in G.defines_edges(nodes).collect()}
    assert got == {(f"d{i % 7}", f"n{i}") for i in range(2000) if f"tide gauge{i % 7}" in rows[i][3]}
    words = nodes.select("graph_id", "node_id", F.explode(G.plain_words(F.col("content"))).alias("word"))
    wanted = spark.createDataFrame([("g", f"gauge{i}") for i in range(7)], "graph_id string, word string")
    kept = G.among(words, wanted, ["graph_id", "word"])
    assert kept.join(wanted, ["graph_id", "word"]).count() == words.join(wanted, ["graph_id", "word"]).count() == 2007 <= kept.count() <= 2007 + 100
    assert G.among(words, wanted.limit(0), ["graph_id", "word"]).count() == 0
