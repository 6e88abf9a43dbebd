"""One path from questions to the nodes that answer them: routing, parts, variants, seeds, traversal and re-ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import six
from knotwork.operators import retrieve as R
from knotwork.operators.graph import content_only
from knotwork.operators.index import inverse_frequencies, search, search_best, term_counts
from knotwork.session import materialise

NODE = ["graph_id", "node_id"]
#: Kinds of questions that do not follow an edge type. Fixed values.
BLOCKED = {"single-session-user": ("summarizes",), "single-session-assistant": ("summarizes",)}


@dataclass(frozen=True)
class Asking:
    """How questions are answered: mode is terms, vectors or hybrid; per_variant seeds for every variant of a part."""

    mode: str = "terms"
    router: bool = True
    per_variant: int = 5
    near: int = 16
    least_cosine: float = 0.2
    traversal: R.Traversal = field(default_factory=R.Traversal)


def term_index(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, idf) of the content nodes, as tables that many questions can share; all graphs are one collection."""
    content = content_only(nodes).select(*NODE, "content")
    counts = materialise(term_counts(content, NODE, "content"), "terms")
    idf = materialise(inverse_frequencies(counts, content.agg(F.count(F.lit(1)).alias("n_texts")), []), "idf")
    return counts, idf


def routed(questions: DataFrame, key: str, text: str, options: Asking) -> DataFrame:
    """(key, asked, kind, max_seeds, max_nodes, spread, summaries): every question with its strategy.

    Without the router there is no kind: 24 seeds and the usual number of nodes,
    for questions that ask for a sum or count 40 and 50, spread over files, and
    summaries are nodes like others.
    """
    asked = questions.where(F.col(text).isNotNull()).select(key, F.col(text).alias("asked")).dropDuplicates([key])
    kind = R.question_type(F.col("asked"))
    if options.router:
        return asked.withColumn("kind", kind).withColumn("_s", R.strategy_of(F.col("kind"))).select(key, "asked", "kind", "_s.max_seeds", "_s.max_nodes", "_s.spread", "_s.summaries")
    sums = R.asks_for_sum(F.col("asked"))
    return asked.select(
        key, "asked", F.lit(None).cast("string").alias("kind"), F.when(sums, 40).otherwise(24).alias("max_seeds"), F.when(sums, 50).otherwise(options.traversal.nodes).alias("max_nodes"),
        F.lit(True).alias("spread"), F.lit(None).cast("boolean").alias("summaries"),
    )


def question_seeds(
    asked: DataFrame, nodes: DataFrame, key: str, options: Asking, index: tuple[DataFrame, DataFrame] | None = None, synonyms: DataFrame | None = None, likeness: DataFrame | None = None
) -> DataFrame:
    """(key, graph_id, node_id, score): the seeds of routed questions.

    Every part of a question, and every variant that related names give it,
    brings its best nodes by terms; likeness (key, graph_id, node_id, cosine)
    brings the nearest by vector. A node keeps its best score, summaries are
    raised or left out by the strategy, and the seeds are dealt over files.
    """
    strategy = asked.select(key, "max_seeds", "spread", "summaries")
    content = content_only(nodes).select(*NODE, "node_type", F.col("source.file").alias("file"))
    flagged = lambda pool: R.summary_policy(pool.join(content.select(*NODE, "node_type"), NODE).join(strategy.select(key, "summaries"), key), prefer="summaries")
    pools = []
    if options.mode != "vectors":
        parts = asked.select(key, F.posexplode(R.sub_queries(F.col("asked"))).alias("part", "asked"))
        parts = materialise(parts.select(key, F.concat_ws("|", F.col(key).cast("string"), F.col("part").cast("string")).alias("part"), "asked"), "parts")
        variants = parts.select("part", F.col("asked").alias("variant")) if synonyms is None else R.expanded(parts.select("part", "asked"), synonyms, "part", "asked")
        variants = variants.join(parts.select("part", key), "part").select(key, "variant").distinct()
        variants = materialise(variants.withColumn("v", F.concat_ws("|", F.col(key).cast("string"), F.sha2("variant", 256))), "variants")
        if index is None:
            texts = content_only(nodes).select(*NODE, "content", F.coalesce(F.col("node_type") == "session-summary", F.lit(False)).alias("summary"))
            raised = variants.join(strategy.select(key, F.col("summaries").alias("raised")), key)
            found = materialise(search_best(texts, raised, "v", "variant", NODE, options.per_variant), "found")
        else:
            found = search(index[0], variants, index[1], "v", "variant", NODE, None)
        found = flagged(found.join(variants.select("v", key), "v"))
        best = Window.partitionBy("v").orderBy(F.desc("score"), "node_id", "graph_id")
        pools.append(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= options.per_variant))
    if options.mode != "terms" and likeness is not None:
        near = likeness.where(F.col("cosine") >= options.least_cosine).select(key, *NODE, F.col("cosine").alias("score"))
        most = F.lit(options.near) if options.mode == "hybrid" else 2 * F.col("max_seeds")
        near = flagged(near).join(strategy.select(key, "max_seeds"), key)
        best = Window.partitionBy(key).orderBy(F.desc("score"), "node_id", "graph_id")
        pools.append(near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most))
    merged = R.merged_seeds(*pools, key=key, node=NODE).join(content.drop("node_type"), NODE).join(strategy.drop("summaries"), key)
    merged = merged.withColumn("file", F.when(F.col("spread"), F.concat_ws("|", "graph_id", F.coalesce("file", F.lit("")))))
    return R.diversified(merged, key, "node_id", "file", "max_seeds").select(key, *NODE, "score")


def ask(
    nodes: DataFrame, directed: DataFrame, undirected: DataFrame, questions: DataFrame, as_of: str, key: str = "q", text: str = "question", options: Asking = Asking(),
    index: tuple[DataFrame, DataFrame] | None = None, synonyms: DataFrame | None = None, likeness: DataFrame | None = None,
) -> DataFrame:
    """(key, graph_id, node_id, score, place): the nodes that answer every question, over all graphs.

    Seeds spread over their own graph (some kinds of questions do not follow
    `summarizes`), the best nodes after temporal re-scoring are kept, what a
    chosen summary sums up is halved, the user's turn joins a chosen answer, and
    with vectors the scores are blended with the cosine. Null questions give no
    rows; a question without seeds has none; repeated questions count once.
    """
    asked = materialise(routed(questions, key, text, options), "asked")
    seeds = materialise(question_seeds(asked, nodes, key, options, index, synonyms, likeness), "seeds")
    kinds = asked.select(key, F.coalesce("kind", F.lit("")).alias("kind"), "max_nodes")
    scores = R.traverse_edges(seeds, directed, undirected, nodes, kinds.select(key, "kind"), key, options.traversal, BLOCKED)
    best = materialise(R.top_nodes(scores.join(kinds.select(key, "max_nodes"), key), nodes, key, as_of, "max_nodes"), "best")
    weak = R.weakened_by_summary(best, nodes, directed, key).withColumn("score", six(F.col("score")))
    found = R.sibling_turns(weak, nodes, key)
    if options.mode != "terms" and likeness is not None:
        found = R.reranked(found, likeness.select(key, *NODE, "cosine"), key, NODE)
    order = Window.partitionBy(key).orderBy(F.desc("score"), "node_id", "graph_id")
    return found.select(key, *NODE, "score", F.row_number().over(order).alias("place"))
