"""Leakage: Wu-Manber against plain search, tables of any size, and odd inputs."""

import random

import numpy as np

from knotwork.llm.leakage import Codes, leaked_items, occurrences, words


def plain(text, items, width):
    w = words(text)
    runs = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {k for k, t in items for v in [words(t)] for i in range(len(v) - width + 1) if tuple(v[i : i + width]) in runs}


def tables(codes, items, bits):
    """The shift table and the marks of test texts, in plain Python."""
    shift, marks = np.full(1 << bits, codes.width - 1, dtype=np.uint8), np.zeros(1 << bits, dtype=np.uint8)
    for _, t in items:
        code = codes.of(words(t))
        for i in range(len(code) - codes.width + 1):
            for j, b in enumerate(codes.blocks(code[i : i + codes.width])):
                at = int(b) & ((1 << bits) - 1)
                shift[at] = min(shift[at], codes.width - 2 - j)
            marks[int(codes.runs(code, np.array([i]))[0]) & ((1 << bits) - 1)] = 1
    return shift, marks


def test_no_occurrence_is_skipped():
    rng = random.Random(1)
    for n in range(200):
        vocabulary = "abcdef"[: rng.randint(2, 6)]
        line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
        items = [(i, line(rng.randint(0, 12))) for i in range(5)]
        text = line(rng.randint(0, 40))
        codes = Codes(rng.randint(3, 6))
        w = words(text)
        twice = [*w, *w]
        starts, _ = occurrences(codes.of(twice), [len(w), len(w), 2 * len(w)], codes, *tables(codes, items, (2, 16)[n % 2]))
        again, starts = {i - len(w) for i in starts.tolist() if i >= len(w)}, starts[starts < len(w)]
        assert again == set(starts.tolist())
        runs = {tuple(v[i : i + codes.width]) for _, t in items for v in [words(t)] for i in range(len(v) - codes.width + 1)}
        want = {i for i in range(len(w) - codes.width + 1) if tuple(w[i : i + codes.width]) in runs}
        assert want <= set(starts.tolist()) and (n % 2 == 0 or want == set(starts.tolist()))


def test_equals_plain_search(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, line(rng.randint(0, 14)), None, "c", "c") for i in range(30)]
    docs = [(i, line(rng.randint(0, 60)), "c", "c") for i in range(60)]
    want = {(d, i) for d, t, *_ in docs for i in plain(t, [(i, p) for i, p, *_ in items], 4)}
    for bits in (4, 26):
        assert {tuple(r) for r in leaked_items(*frames(spark, docs, items), width=4, most_bits=bits).collect()} == want


def test_case_and_markup_between_words(spark):
    d, i = frames(spark, [(1, "...THE **quick**,\n<b>brown</b> b fox", "c", "c"), (2, "x the_QUICK\n\nbrown - fox; jumps y", "c", "c")], [(1, "The quick brown fox jumps over the lazy dog", None, "c", "c")])
    assert [tuple(r) for r in leaked_items(d, i, width=5).collect()] == [(2, 1)]


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, tables string")
    i = spark.createDataFrame(items, "item_id long, passage string, question string, doc_id string, text string")
    return d, i


def test_nulls_repeats_shared_passages_and_clashing_columns(spark):
    p = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"lead {p} tail", "c", "c"), (1, f"lead {p} tail", "c", "c"), (2, None, "c", "c"), (3, "", "c", "c"), (4, p.rsplit(" ", 2)[0], "c", "c"), (5, "ask " * 20, "c", "c")]
    items = [(10, p, "short question", "c", "c"), (11, p, None, "c", "c"), (12, None, "ask " * 12, "c", "c"), (13, "too short", "", "c", "c"), (10, p, "short question", "c", "c")]
    d, i = frames(spark, docs, items)
    assert sorted(map(tuple, leaked_items(d, i).collect())) == [(1, 10), (1, 11), (5, 12)]


def test_empty_tables_and_very_long_text(spark):
    d, i = frames(spark, [(1, "a b c " * 300_000 + "one two three", "c", "c")], [(1, "a b c one two three", "", "c", "c")])
    assert [tuple(r) for r in leaked_items(d, i, width=6).collect()] == [(1, 1)]
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0
