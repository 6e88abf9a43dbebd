"""Names: which spellings are linked and which are not."""

import random
from itertools import combinations

import pytest

from knotwork.llm import names as N

SAME = [
    ["Kenneth Vardrethal", "KENNETH VARDRETHAL", "Vardrethal, Kenneth", "vardrethal kenneth", "Ken Vardrethal", "K. Vardrethal", "Vardrethal, K.", "Dr Kenneth Vardrethal", "Kenneth Vardrethal", "Kenneth  Vardrethal", "Kenneth M. Vardrethal", "Kenneth Vardrtehal", "Kennth Vardrethal", "Kenneth Várdrethal", "K Vardethal", "Kenn. Vardrethal", "Kenneth Vardrethal."],
    ["Eleanor Vardrethal", "Nell Vardrethal", "E. Vardrethal"],
    ["Valimurix Philology Society", "Philology Society Valimurix", "Society of Philology, Valimurix", "The Valimurix Philology Society", "Valimurix Philology Soc.", "Valimurix Soc. of Philology", "Valimurix Society", "Valimurix PS", "Valimurix Philo. Society", "Valimurix Philolgoy Society"],
    ["Valimurix Genetics Foundation", "Foundation of Genetics, Valimurix"],
    ["Francws Istteinger", "Frances Istteinger"],
]
OTHER = ["Michael Sarprithal", "Michael Varprithal", "Oscar Varprithal", "Helga Sarprithal", "Sediment 7", "Sediment 9", "Instrument II", "Instrument III", "Norbriev Springs", "Norbrien Springs", "1959", "`sort_tower`", "Alternative Architecture"]


def test_spellings_are_linked(spark):
    rows = [(x, "c", "c", 1) for group in SAME for x in group for _ in range(2)] + [(x, "c", "c", 1) for x in OTHER] + [(None, "c", "c", 1), ("", "c", "c", 1), (" ", "c", "c", 1)]
    df = spark.createDataFrame(rows, "name string, entity string, key string, rows int")
    got = {tuple(r) for r in N.spelling_pairs(N.link_names(df)).collect()}
    want = {tuple(sorted(p)) for group in SAME for p in combinations(group, 2)}
    assert got == want


def test_ambiguous_short_forms_stay_alone(spark):
    df = spark.createDataFrame([("Karl Vardrethal",), ("Kenneth Vardrethal",), ("Katherine Vardrethal",), ("K. Vardrethal",), ("Vardrethal, K.",)], "name string")
    assert {tuple(r) for r in N.spelling_pairs(N.link_names(df)).collect()} == {("K. Vardrethal", "Vardrethal, K.")}


def test_slips_of_a_name_never_spelt_rightly_meet(spark):
    df = spark.createDataFrame([("Dorothy Orldestad",), ("Helga Orldestad",), ("Katherine Orldestaad",), ("Katherine Orlfestad",), ("Orldestad, K.",)], "name string")
    got = {tuple(r) for r in N.spelling_pairs(N.link_names(df)).collect()}
    assert got == set(combinations(["Katherine Orldestaad", "Katherine Orlfestad", "Orldestad, K."], 2))


def test_empty_table_and_long_names(spark):
    df = spark.createDataFrame([], "name string")
    assert N.link_names(df).count() == 0
    df = spark.createDataFrame([("x" * 100_000,), ("word " * 20_000,), ("University " * 3,)], "name string")
    assert N.spelling_pairs(N.link_names(df)).count() == 0


@pytest.mark.parametrize("a, b, same", [("abc", "abd", True), ("abc", "acb", True), ("abc", "abcd", True), ("abc", "ab", True), ("abc", "abc", True), ("abcd", "badc", False), ("abc", "cba", False), ("abc", "abcde", False)])
def test_one_edit(a, b, same):
    assert N.one_edit(a, b) is same and N.one_edit(b, a) is same


def test_names_outside_the_tables(spark):
    groups = [
        ["Robert Brown", "Bob Brown", "R. Brown", "Brown, Robert"], ["Mohammed Ali", "Ali, Mohammed"], ["Giulia Rossi", "GIULIA ROSSI", "Rossi, Giulia", "G. Rossi", "Giulia Rosssi", "Dr Giulia M. Rossi"],
        ["Wei Zhang", "Zhang, Wei"], ["Acme Widgets Ltd", "Acme Widgets Limited", "ACME WIDGETS LTD"], ["Acme Widgets LLC"], ["Norbriev Springs"], ["Norbrien Springs"], ["Müller Technik GmbH", "Muller Technik gmbh"], ["Acme Ltd", "ACME Limited"],
    ]
    linked = N.link_names(spark.createDataFrame([(x,) for g in groups for x in g], "name string"))
    got = {tuple(r) for r in N.spelling_pairs(linked).collect()}
    assert got == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}
    score = {r.name: r.score for r in linked.collect()}
    assert score["Giulia Rossi"] == 1.0 and 0.5 < score["Giulia Rosssi"] < 1.0


def test_names_of_one_word_many_words_and_with_digits(spark):
    long = "Vereinigte Nordische Handels und Schifffahrts Compagnie von Valimurix Sued"
    groups = [
        ["Vorkowest", "VORKOWEST", "Vórkowest", "Vorkwoest"], ["Vorkovest"], [long, long.upper(), long.replace("Nordische", "Nordishce")], ["Studio 54", "STUDIO 54"], ["Studio 55"], ["Model 12345 Works", "MODEL 12345 WORKS"], ["Model 12346 Works"],
        ["Area 51 Museum", "Museum of Area 51", "AREA 51 MUSEUM"], ["Area 52 Museum"], ["3M Company", "3M Co"], ["`Sort_Tower`", "`sort_tower`"], ["1959"], ["1960"], ["X Y", "x y"], ["The", "THE"], ["Boeing 7 Series"], ["Boeing 8 Series"],
    ]
    groups[0] += groups.pop(1)  # one slip from a name with three spellings
    df = spark.createDataFrame([(x,) for g in groups for x in g] + [(" ",), (None,)], "name string")
    linked = N.link_names(df)
    assert linked.count() == sum(map(len, groups))
    assert {tuple(r) for r in N.spelling_pairs(linked).collect()} == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}


def test_slip_codes_of_long_words_are_those_of_their_deletions():
    for word in ("vardrethal", "abc", "room5", "aabbccdd"):
        assert set(N.deletion_codes(word)) == {N.deletion_codes(d)[0] for d in N.deletions(word)}
    assert set(N.slip_codes("v", ["vardrethal", "ken"])) == set(N.slip_codes("v", ["ken", "vardrethal"])) != set(N.slip_codes("v", ["ken", "vardrethal"], ordered=True))
    assert len(N.slip_codes("v", ["".join(chr(97 + i * i % 23) for i in range(100_000))])) == 100_001


def test_scores_of_short_forms(spark):
    df = spark.createDataFrame([("Kenneth Vardrethal",), ("Katherine Vardrethal",), ("Karl Vardrethal",), ("K. Vardrethal",), ("Kath. Vardrethal",)], "name string")
    got = {r.name: (r.entity, r.score) for r in N.link_names(df).collect()}
    assert got["K. Vardrethal"] == ("p k. vardrethal", 0.5) and got["Kath. Vardrethal"] == ("p katherine vardrethal", 1.0)
    assert {r.name: r.entity for r in N.link_names(df, least_score=0.4).collect()}["K. Vardrethal"] != "p k. vardrethal"


def test_held_out_names_in_plain_measure(spark):
    rng = random.Random(11)
    part = lambda n: "".join(rng.choice(["ba", "ke", "lo", "mi", "ru", "sha", "ti", "vo", "zen", "qu"]) for _ in range(n)).capitalize()
    people = {(part(3), part(4)) for _ in range(120)}
    slip = lambda w: (lambda i: w[:i] + w[i + 1] + w[i] + w[i + 2 :])(rng.randrange(1, len(w) - 2))
    spelt = {p: {f"{p[0]} {p[1]}", f"{p[0]} {p[1]}".upper(), f"{p[1]}, {p[0]}", f"{p[0]} {rng.choice('ABC')}. {p[1]}", f"{p[0]} {slip(p[1])}"} for p in people}
    owner = {}
    for p, names in spelt.items():
        for n in names:
            owner.setdefault(n, set()).add(p)
    got = {tuple(r) for r in N.spelling_pairs(N.link_names(spark.createDataFrame([(n,) for n in owner], "name string"))).collect()}
    want = {tuple(sorted(c)) for names in spelt.values() for c in combinations(names, 2)}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_nothing_is_broadcast_for_its_believed_size(spark, monkeypatch):
    plans, write = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, what: plans.append(df) or write(df, what))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        df = spark.createDataFrame([(x,) for group in SAME for x in group], "name string")
        plans.append(N.spelling_pairs(N.link_names(df)))
        said = "".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in said and "Broadcast" not in said
