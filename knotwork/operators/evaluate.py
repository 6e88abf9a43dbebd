"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import first_number


def keyword_hits(items: DataFrame, found: DataFrame, key: str, expected: str, text: str, part: float = 0.5) -> DataFrame:
    """(key, n_keywords, n_hits, passed): which expected words occur in the texts found for an item; passed at `part` of them, rounded up.

    Items for which nothing was found are left out.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(expected)), F.lit("([a-z0-9]+)"), F.lit(1)))
    asked = items.select(key, F.explode(words).alias("word")).distinct()
    hits = asked.join(found, key).groupBy(key, "word").agg(F.max(F.contains(F.lower(F.col(text)), F.col("word"))).alias("hit"))
    counted = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_keywords"), F.count_if(F.col("hit")).alias("n_hits"))
    return counted.withColumn("passed", F.col("n_hits") >= F.ceil(F.col("n_keywords") * part))


def question_kind(question_id: Column, question_type: Column) -> Column:
    """The type of a question; abstention questions stand apart."""
    return F.concat(question_type, F.when(question_id.endswith("_abs"), "_abs").otherwise(""))


def accuracy_report(graded: DataFrame) -> DataFrame:
    """(kind, n, n_correct, accuracy): share of correct answers in percent, by kind of question and overall."""
    rows = graded.withColumn("kind", question_kind(F.col("question_id"), F.col("question_type")))
    share = F.round(100.0 * F.count_if(F.col("correct")) / F.count(F.lit(1)), 2)
    out = rows.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("n_correct"), share.alias("accuracy"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("overall")))


def miss_bucket(category: Column, wanted: Column, n_found: Column, predicted: Column, gold: Column) -> Column:
    """Why an answer is wrong: routing (another category than wanted), retrieval (nothing found), count_error (another number), other."""
    mine, right = first_number(predicted), first_number(gold)
    return (
        F.when(category.isNotNull() & (category != wanted), "routing").when(F.coalesce(n_found, F.lit(0)) == 0, "retrieval")
        .when(mine.isNotNull() & right.isNotNull() & (mine != right), "count_error").otherwise("other")
    )


def said_yes(answer: Column) -> Column:
    """Whether a judge's answer holds a yes."""
    return F.contains(F.lower(answer), F.lit("yes"))
