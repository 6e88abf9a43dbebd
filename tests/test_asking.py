"""Asking over many nodes: what leaves the scan, and that it is enough."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.operators import ask as A
from knotwork.operators import retrieve as R
from knotwork.operators.index import search, search_best

NODE = ["graph_id", "node_id"]


def made(spark, n=3000):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    rows = [("g", f"n{i}", " ".join(rng.choices(words, k=rng.randrange(9))) if i % 50 else None, i % 7 == 0) for i in range(n)]
    rows += [("h", f"n{i}", "word1 word2 word2", False) for i in range(30)]  # equal scores
    return spark.createDataFrame(rows, "graph_id string, node_id string, content string, summary boolean")


def test_best_matches_are_those_of_the_whole_search(spark):
    texts = made(spark)
    asked = [(f"q{i}", f"word{i} word{(i * 7) % 40} word2 nothing", [None, True, False][i % 3]) for i in range(20)] + [("none", "nothing else", None)]
    queries = spark.createDataFrame(asked, "v string, text string, raised boolean")
    kinds = texts.select(*NODE, F.when(F.col("summary"), "session-summary").alias("node_type"))
    best = Window.partitionBy("v").orderBy(F.desc("score"), "node_id", "graph_id")

    def ranked(found):
        raised = R.summary_policy(found.select("v", *NODE, "score").join(kinds, NODE).join(queries.select("v", F.col("raised").alias("summaries")), "v"))
        return {tuple(r) for r in raised.withColumn("n", F.row_number().over(best)).where("n <= 5").select("v", *NODE, "score", "n").collect()}

    index = A.term_index(texts.withColumn("node_type", F.lit("fact")))
    whole = search(index[0], queries, index[1], "v", "text", NODE, None)
    found = search_best(texts, queries, "v", "text", NODE, 5)
    assert ranked(found) == ranked(whole) and len(ranked(whole)) == 100
    assert found.count() < whole.count() / 3  # the others stay where they are
    assert ranked(search_best(texts, queries, "v", "text", NODE, 5, block=7)) == ranked(search_best(texts, queries, "v", "text", NODE, 5, vocabulary=3)) == ranked(whole)
    assert search_best(texts.limit(0), queries, "v", "text", NODE, 5).count() == search_best(texts, queries.limit(0), "v", "text", NODE, 5).count() == 0


def test_hops_over_edges_are_those_over_all_ways(spark):
    rng = random.Random(6)
    at = lambda: f"n{rng.randrange(300)}"
    one = spark.createDataFrame([("g", at(), at(), rng.choice(["cites", "summarizes", None]), rng.choice([None, 0.2, 0.5, 1.0])) for _ in range(600)] + [("g", None, "n1", "cites", 1.0)], "graph_id string, from_node string, to_node string, edge_type string, weight double")
    two = spark.createDataFrame([("g", at(), at(), "similar-to", rng.random()) for _ in range(300)], "graph_id string, node_a string, node_b string, edge_type string, weight double")
    nodes = spark.createDataFrame([("g", f"n{i}") for i in range(280)], "graph_id string, node_id string")  # some ends dangle
    seeds = spark.createDataFrame([(q, "g", at(), 0.9) for q in ("a", "b") for _ in range(4)], "q string, graph_id string, node_id string, score double")
    kinds = spark.createDataFrame([("a", ""), ("b", "single-session-user")], "q string, kind string")
    got = {(r.q, r.node_id, round(r.score, 12)) for r in R.traverse_edges(seeds, one, two, nodes, kinds, "q", R.Traversal(), A.BLOCKED).collect()}
    want = set()
    for q, blocked in (("a", ()), ("b", ("summarizes",))):
        ways = R.neighbours(one, two, nodes, 0.5, blocked)
        want |= {(r.q, r.node_id, round(r.score, 12)) for r in R.traverse(seeds.where(F.col("q") == q), ways, "q").collect()}
    assert got == want and len(want) > 50
