"""Closures and cascades that are deeper or wider than the test tables show."""

from knotwork.operators import graph as G
from knotwork.plans import report_queries as Q


def test_closure_follows_long_chains(spark):
    edges = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}") for i in range(200)], "graph_id string, from_node string, to_node string")
    roots = spark.createDataFrame([("g", "n0"), ("g", "n40")], "graph_id string, node_id string")
    got = {tuple(r)[1:] for r in G.closure(edges.coalesce(1), roots).collect()}
    assert got == {("n0", f"n{i}") for i in range(201)} | {("n40", f"n{i}") for i in range(40, 201)}


def test_cascade_of_any_deleted_node(spark, monkeypatch):
    node = "graph_id string, node_id string, source struct<file: string>, metadata map<string, string>"
    nodes = spark.createDataFrame([("g", "a", ("f",), {"deleted_at": "1"}), ("g", "b", ("f",), {}), ("g", "c", ("h",), {}), ("g", "d", (None,), {"deleted_at": "2"}), ("g", "e", (None,), None)], node)
    edges = spark.createDataFrame([("g", "b", "c", "contains"), ("g", "d", "e", "contains")], "graph_id string, from_node string, to_node string, edge_type string")
    monkeypatch.setattr(Q, "graph_nodes", lambda *_: nodes)
    monkeypatch.setattr(Q, "directed", lambda *_: edges)
    assert {(r.root, r.node_id) for r in Q.cascade_closure(spark, "").collect()} == {("a", "b"), ("a", "c"), ("d", "e")}
    assert {tuple(r)[1:] for r in Q.cascade_closure_all(spark, "").collect()} == {("a", 2), ("d", 1)}
