"""Reading levels: held-out accuracy and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import reading as N
from knotwork.llm.reading import BANDS, fit_reading, rated, reading_levels, word_difficulties

WORDS = {b: [f"{b}{i}" for i in range(60)] for b in BANDS}
GRADES = {"early": 2, "middle": 6, "upper": 11, "expert": 16}


def document(rng, band, other, share):
    lines = []
    for _ in range(20):
        level = other if rng.random() < share else band
        lines.append(" ".join(rng.choice(WORDS[level] + ["the", "of", "and"]) for _ in range(9)) + ".")
    return " ".join(lines)


def test_held_out_bands(spark):
    rng = random.Random(3)
    docs = []
    for i in range(400):
        band = BANDS[i % 4]
        docs.append((i, document(rng, band, rng.choice(BANDS), 0.25), band, 1))
    labels = [(i, "r", GRADES[b], i) for i, _, b, _ in docs if i < 100 for _ in range(1)] + [(4, "r", 17, 0), (5, "r", None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, band string, level int")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, grade int, text long")
    got = {r.doc_id: r.band for r in reading_levels(df, lab).collect()}
    held_out = [i for i in range(100, 400)]
    assert sum(got[i] == docs[i][2] for i in held_out) >= 0.97 * len(held_out)


def test_nulls_short_empty_repeated_and_unlabelled(spark):
    text = "the cat sat on the mat. " * 10
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "short text"), (5, "12 34 " * 30)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    got = {r.doc_id: r for r in reading_levels(df, none).collect()}
    assert set(got) == {1, 5} and abs(sum(got[1][b] for b in BANDS) - 1) < 1e-6
    assert reading_levels(df.limit(0), none).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat. " * 50_000)], "doc_id long, text string")
    assert reading_levels(df, spark.createDataFrame([(1, 2)], "doc_id long, grade int")).collect()[0].band == "early"


def test_labels_held_out_on_the_test_data(spark, small):
    larger = small.replace("sf0.001", "sf0.1")
    try:
        labels = spark.read.parquet(f"{larger}/reading_labels.parquet")
    except Exception:
        pytest.skip("no larger test data here")
    docs = spark.read.parquet(f"{larger}/documents.parquet").where(F.lower("lang").startswith("en") & (F.col("doc_format") != "table"))
    known = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = reading_levels(docs, labels.where(known))
    edges = lambda g: F.when(g < 3.5, "early").when(g < 8.5, "middle").when(g < 13.5, "upper").otherwise("expert")
    rest = labels.where(~known & F.col("grade").isNotNull()).withColumn("b", edges(F.col("grade"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"))
    agreed = rest.where("n > 1 and lo = hi").join(got, "doc_id").select((F.col("band") == F.col("lo")).alias("ok")).collect()
    assert len(agreed) > 50 and sum(r.ok for r in agreed) >= 0.97 * len(agreed)


def test_curves_recover_the_parameters():
    rng = np.random.default_rng(5)
    level = rng.uniform(1, 17, 60_000)
    at, _ = np.histogram(level, bins=np.append(N.GRID - 0.25, 17.25))
    place = np.round((level - 1) * 2).astype(int)
    true = np.array([[-1.0, 1.2, 0.0], [-0.5, -1.0, -2.0], [-2.0, 0.0, 0.0], [0.5, 2.0, -3.0]])
    said = rng.random((4, len(level))) < 1 / (1 + np.exp(-(true @ N.POWERS)[:, place]))
    t = N.T[place]
    got = N.curves(said.sum(axis=1), said @ t, said @ (t * t), at.astype(float))
    assert np.abs(got - true).max() < 0.12
    peak = 9 - 5 * got[3, 1] / (2 * got[3, 2])
    assert abs(peak - (9 + 5 * 2.0 / 6.0)) < 0.3
    assert np.isfinite(N.curves(np.array([0.0, 5.0, float(at.sum())]), np.zeros(3), np.array([0.0, 20.0, 0.0]), at.astype(float))).all()


def test_difficulties_rare_words_and_trace(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, document(rng, BANDS[i % 4], BANDS[0], 0.0) + f" rare{i // 4}x{i % 4} word.", i) for i in range(160)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, GRADES[BANDS[i % 4]]) for i in range(60)], "doc_id long, grade int")
    model = fit_reading(docs, labels)
    assert len(model.trace) > 1 and all(b > a for a, b in zip(model.trace, model.trace[1:]))
    words = {r.word: r for r in word_difficulties(docs, model).collect()}
    mean = [sum(words[w].difficulty for w in WORDS[b]) / 60 for b in BANDS]
    assert mean == sorted(mean) and words["the"].discrimination < 0.5 and words["rare3x1"].n_sentences == 1
    few = fit_reading(docs, labels, sent_words=100)
    assert 0 < len(few.scale.words) <= 100
    assert {r.doc_id: r.band for r in rated(few).collect()} == {r.doc_id: r.band for r in rated(model).collect()}
    assert max(abs(a - b) for a, b in zip(few.trace, model.trace)) < 1e-3 * abs(model.trace[0])
