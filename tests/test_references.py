"""Dangling references: reasons, periods, skew and odd inputs."""

from datetime import datetime as D

from pyspark.sql import functions as F

from knotwork.operators.references import dangling_references, references_by_period, stored_time
from knotwork.operators.spread import hot_keys, join_spread, next_in_group, rank_in_slices

NODE = "graph_id string, node_id string, metadata map<string,string>, created_at timestamp_ntz, key string, parent boolean"
EDGE = "graph_id string, edge_id string, from_node string, to_node string, created_at timestamp_ntz, key string, at string, reason string, n long"


def frames(spark, nodes, edges):
    n = spark.createDataFrame([(*x, "c", True) for x in nodes], NODE)
    e = spark.createDataFrame([(*x, "c", "c", "c", 1) for x in edges], EDGE)
    return n, {"directed_edges": (e, ["from_node", "to_node"])}


def test_reasons_months_nulls_and_repeats(spark):
    t = D(2024, 3, 1)
    nodes = [("g", "a", {}, t), ("g", "a", {}, t), ("g", "gone", {"deleted_at": "2024-04-01T00:00:00.000Z"}, t), ("g", "ms", {"deleted_at": "1711929600000"}, t), ("h", "other", None, t), ("g", "odd", {"deleted_at": "?"}, None), (None, "free", {}, t)]
    edges = [
        ("g", "1", "a", "nobody", D(2024, 5, 1)), ("g", "1", "a", "nobody", D(2024, 5, 1)), ("g", "2", "gone", "ms", D(2024, 4, 1)), ("g", "3", "gone", "ms", D(2024, 3, 31)),
        ("g", "4", "a", None, D(2024, 2, 29)), ("g", "5", "gone", "nobody", None), ("g", "6", "other", "odd", D(2024, 6, 1)), (None, "7", "a", "free", D(2024, 6, 1)), ("g", "8", "gone", "a", D(2024, 1, 1)),
    ]
    got = {tuple(r) for r in dangling_references(*frames(spark, nodes, edges)).collect()}
    d = "directed_edges"
    assert got == {
        (d, "1", "to_node", "missing", "2024-05"), (d, "2", "from_node", "deleted", "2024-04"), (d, "2", "to_node", "deleted", "2024-04"), (d, "4", "from_node", "late", "2024-02"), (d, "5", "to_node", "missing", "none"),
        (d, "6", "from_node", "missing", "2024-06"), (d, "7", "from_node", "missing", "2024-06"), (d, "7", "to_node", "missing", "2024-06"), (d, "8", "from_node", "late", "2024-01"), (d, "8", "to_node", "late", "2024-01"),
    }
    sums = {(r.month_key, r.reason): r.n_ends for r in references_by_period(*frames(spark, nodes, edges)).where("end_name = 'from_node'").collect()}
    assert sums[("2024-06", "missing")] == 2


def test_empty_tables_and_long_ids(spark):
    t = D(2024, 1, 1)
    assert dangling_references(*frames(spark, [], [])).count() == 0
    assert dangling_references(*frames(spark, [], [("g", "1", "x" * 100_000, "b", t)])).count() == 2
    assert dangling_references(*frames(spark, [("g", "a", {}, t)], [])).count() == 0


def test_a_key_that_most_ends_name(spark):
    t = D(2024, 1, 2)
    edges = [("g", str(i), "hub" if i % 3 else f"n{i}", "gone", t) for i in range(2000)]
    nodes = [("g", f"n{i}", {}, D(2024, 1, 1)) for i in range(0, 2000, 3)]
    got = dangling_references(*frames(spark, nodes, edges))
    assert got.where("end_name = 'to_node'").count() == 2000 and got.where("end_name = 'from_node'").count() == sum(1 for i in range(2000) if i % 3)


def test_stored_times(spark):
    df = spark.createDataFrame([("1711929600000",), ("2024-04-01T00:00:00Z",), ("2024-04-01T02:00:00+02:00",), ("x",), (None,)], "s string")
    got = [r[0] for r in df.select(stored_time(F.col("s"))).collect()]
    assert got == [D(2024, 4, 1)] * 3 + [None, None]


def test_hot_keys_join_and_ranks(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)], "k string, v long")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    hot = hot_keys(counts, 550, share=10, floor=10)
    assert [r.k for r in hot.collect()] == ["hot"]
    right = rows.groupBy("k").agg(F.max("v").alias("m"))
    assert join_spread(rows, right, ["k"], hot).count() == 550
    ranked = rank_in_slices(rows, "k", ["v"], size=60)
    hot_rows = ranked.where("k = 'hot'")
    assert hot_rows.select("slice").distinct().count() > 5 and hot_rows.groupBy("slice").count().agg(F.max("count")).first()[0] <= 60


def test_bursts_and_outlying_places_are_sliced_too(spark):
    places = [0, 10**12] + [7_000_000] * 300 + list(range(7_000_001, 7_000_200))
    rows = spark.createDataFrame([("hot", v, i) for i, v in enumerate(places)] + [("k", 1, 1), (None, None, 2)], "k string, v long, id long")
    ranked = rank_in_slices(rows, "k", ["v", "id"], size=50).collect()
    hot = sorted((r.slice, r.local_no, r.v, r.id) for r in ranked if r.k == "hot")
    assert [r[2:] for r in hot] == sorted((v, i) for i, v in enumerate(places)) and len(ranked) == len(places) + 2
    sizes = [sum(1 for r in hot if r[0] == s) for s in {r[0] for r in hot}]
    assert len(sizes) > 5 and max(sizes) <= 100


def test_next_in_hot_groups(spark):
    rows = spark.createDataFrame([("hot", None, i * 3, f"h{i:03}") for i in range(300)] + [(None, "s", 1, "a"), (None, "s", 2, "b"), ("k", None, 1, "c")], "k string, s string, ord long, id string")
    want = {(f"h{i:03}", f"h{i + j:03}", j) for i in range(300) for j in (1, 2) if i + j < 300} | {("a", "b", 1)}
    for floor in (50_000, 40):
        got = next_in_group(rows, ["k", "s"], ["ord", "id"], "id", 2, floor=floor)
        assert {(r.x, r.y, r.step) for r in got.collect()} == want
    assert next_in_group(rows.limit(0), ["k", "s"], ["ord", "id"], "id", 2).count() == 0
