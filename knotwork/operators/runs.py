"""Runs of many questions: what is still to do, results that are kept, and what they cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import providers as M
from knotwork.operators.evaluate import said_yes
from knotwork.sources.files import read_results

RESULT = (
    "question_id string, question_type string, abstention boolean, question string, gold string, predicted string, correct boolean, judge_raw string, "
    "n_nodes long, node_types map<string,long>, error string"
)
#: What a judge is asked, by kind of question, and how it must answer. Fixed values.
RULES = {
    "abstention": "The question cannot be answered. Is the answer that it cannot be told?",
    "temporal-reasoning": "Does the answer agree with the right one? Numbers of days, weeks or months may be off by one.",
    "knowledge-update": "Does the answer give the newest state, as the right one does? Older states may stand beside it.",
    "single-session-preference": "Does the answer use what is known of the user, as the rubric says? It need not cover all of it.",
}
USUAL_RULE = "Does the answer hold the right one, or say the same in other words? A part of it is not enough."


def done_questions(spark: SparkSession, path: str) -> DataFrame:
    """The results under a path; none if nothing is stored there. Lines cut off by a failure are dropped."""
    try:
        return read_results(spark, path, RESULT)
    except AnalysisException:
        return spark.createDataFrame([], RESULT)


def to_do(items: DataFrame, done: DataFrame) -> DataFrame:
    """The items whose question has no result yet; results with an error count as none."""
    return items.join(done.where("error is null").select("question_id"), "question_id", "left_anti")


def with_traces(results: DataFrame, traces: DataFrame) -> DataFrame:
    """results with the columns of their traces, where there are any."""
    return results.join(traces.dropDuplicates(["question_id"]), "question_id", "left")


def type_distribution(best: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, node_type, n): how many chosen nodes (key, graph_id, node_id) are of each type."""
    held = best.join(nodes.select("graph_id", "node_id", "node_type"), ["graph_id", "node_id"])
    return held.groupBy(key, "node_type").agg(F.count(F.lit(1)).alias("n"))


def judge_prompt(kind: Column, abstention: Column, question: Column, gold: Column, predicted: Column) -> Column:
    """What to ask a judge about an answer, by kind of question."""
    rule = F.when(abstention, RULES["abstention"])
    for name in [r for r in RULES if r != "abstention"]:
        rule = rule.when(kind == name, RULES[name])
    right = F.coalesce(gold, F.lit("none"))
    return F.concat(rule.otherwise(USUAL_RULE), F.lit(" Say yes or no only.\n\nQuestion: "), question, F.lit("\nRight answer: "), right, F.lit("\nAnswer: "), F.coalesce(predicted, F.lit("")))


def graded(items: DataFrame, answers: DataFrame, sizes: DataFrame, types: DataFrame, judge: Callable[[], M.TextModel]) -> DataFrame:
    """Result rows for items (question_id, question_type, question, answer) with answers (question_id, predicted), sizes (question_id, n_nodes) and types of their nodes.

    A question without an answer, and one whose judge fails, has an error and no
    verdict; it is asked again by the next run.
    """
    kinds = types.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("node_type", F.lit("none")).alias("t"), "n"))).alias("node_types"))
    rows = items.join(answers, "question_id", "left").join(sizes, "question_id", "left").join(kinds, "question_id", "left")
    rows = rows.withColumn("abstention", F.col("question_id").endswith("_abs"))
    asked = rows.where("predicted is not null").withColumn("prompt", judge_prompt(F.col("question_type"), F.col("abstention"), F.col("question"), F.col("answer"), F.col("predicted")))
    said = M.answered(asked, "question_id", "prompt", judge).withColumnRenamed("answer", "judge_raw")
    out = rows.join(said, "question_id", "left")
    error = F.when(F.col("predicted").isNull(), "no answer").when(F.col("judge_raw").isNull(), "no verdict")
    return out.select(
        "question_id", "question_type", "abstention", "question", F.col("answer").alias("gold"), "predicted", F.when(error.isNull(), said_yes(F.col("judge_raw"))).alias("correct"), "judge_raw",
        F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), "node_types", error.alias("error"),
    )


def append_results(results: DataFrame, path: str) -> None:
    """Adds result rows to the JSON lines under a path."""
    results.write.mode("append").option("ignoreNullFields", "true").json(path)


def count_errors(results: DataFrame, mine: str, right: str) -> DataFrame:
    """(question_type, n, n_over, n_under, mean_off): wrong numbers by kind of question, above and below the right one."""
    off = results.where(F.col(mine).isNotNull() & F.col(right).isNotNull() & (F.col(mine) != F.col(right))).withColumn("off", F.col(mine) - F.col(right))
    return off.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("off") > 0).alias("n_over"), F.count_if(F.col("off") < 0).alias("n_under"), F.round(F.avg("off"), 6).alias("mean_off"))


def cost_summary(texts: DataFrame, sizes: DataFrame, seconds: float) -> DataFrame:
    """(n_questions, mean_ms, mean_nodes, mean_tokens): what questions cost, with a token for every four characters of their texts (key, text); seconds is what all took together."""
    rows = texts.join(sizes, texts.columns[0])
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("n_questions"), F.round(F.lit(seconds * 1000) / n, 2).alias("mean_ms"), F.round(F.avg("n_nodes"), 1).alias("mean_nodes"), F.round(F.avg(F.ceil(F.length("text") / 4))).cast("long").alias("mean_tokens")
    )
