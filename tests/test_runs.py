"""Runs of questions: resuming, judging, summaries."""

from pyspark.sql import functions as F

from knotwork.operators import identities as P
from knotwork.operators import retrieve as R
from knotwork.operators import runs as U


class Judge:
    def answer(self, prompts):
        return ["Yes." if "cannot be told" in p or "blue" in p.rsplit("Answer:", 1)[1] else "no" for p in prompts]


def test_results_are_kept_and_resumed(spark, tmp_path):
    path = str(tmp_path / "results")
    items = spark.createDataFrame([("a", "temporal-reasoning", "When?", "blue"), ("b_abs", "multi-session", "Who?", None), ("c", "x", "What?", "red"), ("d", "x", "Which?", "red")], "question_id string, question_type string, question string, answer string")
    assert U.to_do(items, U.done_questions(spark, path)).count() == 4
    answers = spark.createDataFrame([("a", "it is blue"), ("b_abs", "nobody"), ("c", "green")], "question_id string, predicted string")
    sizes = spark.createDataFrame([("a", 3)], "question_id string, n_nodes long")
    types = spark.createDataFrame([("a", "fact", 2), ("a", None, 1)], "question_id string, node_type string, n long")
    U.append_results(U.graded(items, answers, sizes, types, Judge), path)
    got = {r.question_id: r for r in U.done_questions(spark, path).collect()}
    assert got["a"].correct and got["a"].node_types == {"fact": 2, "none": 1} and got["a"].n_nodes == 3 and got["b_abs"].correct and got["b_abs"].abstention
    assert got["c"].correct is False and got["d"].correct is None and got["d"].error == "no answer"
    assert [r.question_id for r in U.to_do(items, U.done_questions(spark, path)).collect()] == ["d"]
    traced = U.with_traces(U.done_questions(spark, path), spark.createDataFrame([("a", "route")], "question_id string, category string"))
    assert traced.count() == 4 and traced.where("category = 'route'").count() == 1


def test_costs_and_wrong_numbers(spark):
    texts = spark.createDataFrame([("a", "x" * 9), ("b", "y" * 4)], "q string, text string")
    sizes = spark.createDataFrame([("a", 3), ("b", 4)], "q string, n_nodes long")
    assert tuple(U.cost_summary(texts, sizes, 1.0).first()) == (2, 500.0, 3.5, 2)
    rows = spark.createDataFrame([("x", 3, 2), ("x", 1, 2), ("x", 6, 2), ("y", 2, 2), ("y", None, 2)], "question_type string, mine long, gold long")
    assert [tuple(r) for r in U.count_errors(rows, "mine", "gold").collect()] == [("x", 3, 2, 1, 4 / 3)] or abs(U.count_errors(rows, "mine", "gold").first().mean_off - 1.333333) < 1e-6


def test_intents_and_person_content(spark):
    df = spark.createDataFrame([("How many cats?", "x"), ("My favourite tea", None), (None, None)], "q string, r string")
    got = [tuple(r) for r in df.select(R.asks_for_sum(F.col("q")), R.asks_for_taste(F.col("q")), P.person_content(F.lit("Ada"), F.col("r"), F.lit("Acme"))).collect()]
    assert got == [(True, False, "Ada (x) at Acme"), (False, True, "Ada at Acme"), (None, None, "Ada at Acme")]
