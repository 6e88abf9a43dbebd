"""Near copies: exact recall on fixtures, buckets that overflow, copies, and odd inputs."""

import random
from itertools import combinations

import pytest

from knotwork.llm import nearcopies as N
from knotwork.llm.leakage import words


def exact(texts, threshold=0.5, least=20):
    sets = {}
    for k, t in texts:
        w = words(t)
        if len(w) >= least:
            sets[k] = set(zip(w, w[1:], w[2:]))
    return {tuple(sorted((a, b))) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(rng, families, size, edits):
    out = []
    for f in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(25, 70))]
        for i in range(size):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = f"z{rng.randint(0, 10_000)}"
            out.append((f"n{f:03}-{i}", " ".join(t)))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, "c", "c") for k, t in texts], "node_id string, content string, cls int, a string, key string")


@pytest.mark.parametrize("options", [{}, {"limit": 3, "max_levels": 2}, {"limit": 2, "max_levels": 1}])
def test_all_pairs_are_found(spark, options):
    texts = corpus(random.Random(5), 40, 5, 8)
    got = {tuple(r) for r in N.near_copy_pairs(frame(spark, texts), **options).collect()}
    want = exact(texts)
    assert got <= want and len(want - got) <= len(want) // 100
    assert want


def test_copies_nulls_short_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    texts = [("a", t), ("b", t.upper().replace(" ", ", ")), ("c", t + " more words"), ("d", None), ("e", ""), ("f", "too short"), ("a", t), ("g", "1 2 3 " * 30)]
    got = {tuple(r) for r in N.near_copy_pairs(frame(spark, texts)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = {r.node_id: (r.n_copies, r.n_links) for r in N.near_copy_groups(frame(spark, texts)).collect()}
    assert groups == {"a": (2, 1), "b": (2, 1), "c": (1, 1), "g": (1, 0)}


def test_group_of_a_chain(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [("a", base), ("b", base[6:] + [f"x{i}" for i in range(8)]), ("c", base[14:] + [f"x{i}" for i in range(16)])]
    rows = N.near_copy_groups(frame(spark, [(k, " ".join(v)) for k, v in chain])).collect()
    assert len({r.group_id for r in rows}) == 1


def test_empty_table_and_very_long_text(spark):
    assert N.near_copy_pairs(frame(spark, [])).count() == 0
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    assert [tuple(r) for r in N.near_copy_pairs(frame(spark, [("a", long), ("b", long + " end")])).collect()] == [("a", "b")]


def test_blocks_meet_every_pair(spark):
    over = spark.createDataFrame([(1, i) for i in range(57)] + [(2, i) for i in range(3)], "path long, cls long")
    got = {(r.a, r.b) for r in N.all_in_blocks(over, block=10).collect() if r.path == 1}
    assert got == set(combinations(range(57), 2))


def test_runs_go_on_until_the_recall_is_reached(spark):
    texts = corpus(random.Random(8), 30, 6, 9)
    want = exact(texts)
    few = {tuple(r) for r in N.near_copy_pairs(frame(spark, texts), runs=1, recall=0.0).collect()}
    all_runs = {tuple(r) for r in N.near_copy_pairs(frame(spark, texts), runs=4, recall=0.99).collect()}
    assert len(few) < len(all_runs) and len(all_runs & want) >= 0.99 * len(want) and all_runs <= want
    with pytest.raises(RuntimeError):
        N.near_copies(frame(spark, texts), runs=1, recall=1.1, most_batches=1)


def test_recall_is_estimated_from_single_and_double_meetings(spark):
    rows = [(1, 0)] * 10 + [(3, 0)] * 20 + [(7, 0)] * 70 + [(1, 16)] * 2 + [(5, 16)] * 0
    got = N.estimated_recall(spark.createDataFrame(rows, "runs long, deep int"))
    assert abs(got - 102 / (102 + 90 / 42 + 2 / 2)) < 1e-9


def test_classes_of_different_sets_are_told_apart(spark):
    sets = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 6), ("d", 2, 5)], "key string, cls long, check long")
    got = {r.key: r.cls for r in N.apart(sets).collect()}
    assert got["a"] == got["b"] == 1 and got["c"] not in (1, 2) and got["d"] == 2
