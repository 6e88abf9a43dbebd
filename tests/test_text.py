"""Text functions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from knotwork.functions import text as X


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("text", ["The Cat's 2 cats; a I AI naïve x", "", "  the of and ", None, "été 99 bottles", "word " * 5000])
def test_tokens(spark, text):
    want = None if text is None else [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", text.lower())) if len(t) > 1 and t not in X.STOPWORDS]
    assert one(spark, text, X.tokens) == want


def djb(text):
    h = 5381
    for c in text:
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    digits, n = "", abs(h)
    while n:
        digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
    return ("-" if h < 0 else "") + digits


@pytest.mark.parametrize("text", ["", "a", "hello world", "Ünïcode → text", "x" * 300])
def test_string_hash(spark, text):
    assert one(spark, text, X.string_hash) == djb(text)


def pack(text):
    out = []
    for p in re.split(r"\n\n+", text):
        if not p.strip():
            continue
        if len(p) <= 500:
            out.append(p.strip())
            continue
        now = []
        for s in [s for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]:
            now.append(s)
            if len(now) >= 3 or len(" ".join(now)) > 500:
                out.append(" ".join(now).strip())
                now = []
        if now:
            out.append(" ".join(now).strip())
    return out


@pytest.mark.parametrize("text", ["", "one\n\ntwo", "A short. " * 100, "no stop " * 200, "\n\n \n\n", ("x" * 600 + ". ") * 3, "One! Two? " * 80 + "\n\nend"])
def test_chunks(spark, text):
    assert one(spark, text, X.chunks) == pack(text)


@pytest.mark.parametrize(
    "text, want",
    [("An atom is a small thing.", "definition"), ("An atom is a thing. " * 20, "fact"), ("Founded in 1999 by", "event"), ("It cost 5 million", "data-point"), ("50% of it", "fact"), ("According to him", "claim"), ("", "fact"), (None, None), ("the meansé x", "definition")],
)
def test_chunk_type(spark, text, want):
    assert one(spark, text, X.chunk_type) == want


def test_entities_links_and_terms(spark):
    text = "Alan Turing met The Queen in 1936 at NASA. however Bletchley, `code x` AM 2035 1000"
    assert one(spark, text, X.entities) == ["Alan Turing", "The Queen", "Turing", "Queen", "Bletchley", "1936", "1000", "NASA", "code x"]
    assert one(spark, None, X.entities) is None and one(spark, "", X.entities) == []
    assert one(spark, "[a](b_c) [[D e]] [x]", X.links) == ["b_c", "D e"]
    assert [one(spark, t, X.defined_term) for t in ("Graph is defined as x", "A node refers to", "Rust is the best", "The old map is old", "no term")] == ["Graph", "A node", "Rust", "old map", None]


def test_small_functions(spark):
    assert one(spark, "Built in 1850 and 1900", X.first_year) == 1850 and one(spark, "in 2030", X.first_year) is None
    assert one(spark, "Hello, World!", X.slug) == "hello-world"
    assert one(spark, "2023/03/31 (Fri) 14:13", X.day_tag) == "2023-03-31 (Fri)" and one(spark, "soon", X.day_tag) is None
    assert one(spark, "about seven or 8", X.first_number) == 8.0 and one(spark, "Seven", X.first_number) == 7.0 and one(spark, "none", X.first_number) is None
    assert one(spark, "<p>a <b>b</b></p>", X.without_tags) == "a b"
    assert one(spark, "Ada Lovelace", X.likely_person) and not one(spark, "ADA Lovelace", X.likely_person)
    df = spark.createDataFrame([(["A", "b"], ["a", "C"], [1.0, 0.0], [1.0, 1.0]), ([], [], [0.0], [1.0])], "x array<string>, y array<string>, u array<float>, v array<float>")
    got = df.select(X.jaccard(F.col("x"), F.col("y")), X.dense_cosine(F.col("u"), F.col("v"))).collect()
    assert got[0][0] == pytest.approx(1 / 3) and got[0][1] == pytest.approx(0.5**0.5) and tuple(got[1]) == (0.0, 0.0)
    assert [one(spark, v, X.confidence_trend, "double") for v in (0.9, 0.8, 0.5)] == ["stable", "rising", "decaying"]
