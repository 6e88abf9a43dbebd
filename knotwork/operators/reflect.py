"""Reflection: contradictions, discoveries, decay and inference, each as new rows that the caller may merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import domain, edged, jaccard, six, tokens
from knotwork.operators.graph import content_only, needed_names
from knotwork.operators.index import inverse_frequencies, term_counts, unit_weights
from knotwork.operators.spread import join_sliced, met_in_blocks, met_with_some
from knotwork.session import materialise

#: Names too general to compare claims by. Fixed values.
GENERIC = """
first second third last new old next previous general special common standard modern early late large small high low long short
major minor important significant similar different various several many most some other such based used known called named given
made found developed designed published released introduced proposed described gaussian linear digital analog binary parallel
system model method process program device
""".split()
#: Signs that a text disagrees with another. Fixed values.
CONFLICTS = [
    r"(?<![A-Za-z0-9_])not\s+(?:a|an|the)\s", edged("no longer"), edged(r"was\s+(?:not|never)"), edged(r"replaced\s+by"), edged(r"contrary\s+to"), edged(r"is\s+(?:incorrect|wrong|false|inaccurate)"),
    edged(r"was\s+(?:incorrect|wrong|false|inaccurate)"), edged("reclassified"), edged("disputed"), edged("disproven"),
]
FIRST = "cdinrw"  # the letters with which the signs begin
#: Edge types along which an inference may go. Fixed values.
TRANSITIVE = ["causes", "depends-on", "supports"]


def conflicting(text: Column) -> Column:
    """Whether a text bears a sign of conflict, by one scan for all signs; places where none begins are passed over by their first letter."""
    return F.lower(text).rlike(rf"(?=[{FIRST}])(?:{'|'.join(CONFLICTS)})")


def sharing_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """(node_a, node_b, jaccard): content nodes of a graph that have at least `least` of all their names in common.

    They meet, in blocks, over the rarest names that a node needs for that.
    """
    item = needed_names(nodes, least).select("graph_id", "name", "n", F.struct("ord", "node_id", "names").alias("item"))
    share = F.size(F.array_intersect("x.names", "y.names")) / F.size(F.array_union("x.names", "y.names"))
    met = met_in_blocks(item, ["graph_id", "name"], n="n").where(share >= least)
    return met.select(F.col("x.node_id").alias("node_a"), F.col("y.node_id").alias("node_b"), F.round(share, 6).alias("jaccard")).distinct()


def contradictions(nodes: DataFrame, overlap: float = 0.6, likeness: float = 0.15) -> DataFrame:
    """(graph_id, node_a, node_b, n_shared): pairs that name the same things, say little alike, and of which one disagrees.

    A pair of a graph counts if it shares a telling name (four letters or more,
    no number, not general) and two names of four letters or more, its names
    overlap by more than `overlap`, the cosine of its terms is below `likeness`,
    both texts have 80 characters, and one bears a sign of conflict. Pairs meet,
    in blocks, over the rarest names that a node needs for that overlap, those
    with a sign of conflict with all others, so that no name is too frequent and
    texts that agree do not meet. Every pair comes once, the earlier node first. Null
    contents and nodes without names give no pairs.
    """
    nodes = content_only(nodes).where((F.col("node_type") != "person") & (F.length("content") >= 50))
    long = nodes.where(F.length("content") >= 80)
    telling = F.filter(F.array_distinct("entities"), lambda e: (F.length(e) >= 4) & ~e.rlike("^[0-9]+$") & ~F.lower(e).isin(GENERIC))
    side = long.select("graph_id", "node_id", "ord", telling.alias("telling"), conflicting(F.col("content")).alias("odd"))
    item = needed_names(long, overlap - 1e-9).join(side, ["graph_id", "node_id", "ord"])
    item = materialise(item.select("graph_id", "name", "n", F.struct("ord", "node_id", "names", "telling", "odd").alias("item")), "named")
    met = met_with_some(item.where("item.odd"), item, ["graph_id", "name"], n="n").where((F.col("x.node_id") != F.col("y.node_id")) & F.arrays_overlap("x.telling", "y.telling"))
    shared = F.size(F.filter(F.array_intersect("x.names", "y.names"), lambda e: F.length(e) >= 4))
    met = met.where((jaccard(F.col("x.names"), F.col("y.names")) > overlap) & (shared >= 2))
    one, two = F.struct("x.ord", "x.node_id"), F.struct("y.ord", "y.node_id")
    pairs = met.select("graph_id", F.least(one, two)["node_id"].alias("a"), F.greatest(one, two)["node_id"].alias("b"), shared.alias("n_shared"))
    pairs = materialise(pairs.distinct(), "pairs")
    if pairs.isEmpty():  # no term needs counting
        return pairs.toDF("graph_id", "node_a", "node_b", "n_shared")
    ends = pairs.select("graph_id", F.explode(F.array("a", "b")).alias("node_id")).distinct()
    told = materialise(term_counts(nodes.join(ends, ["graph_id", "node_id"], "left_semi"), ["graph_id", "node_id"], "content"), "told")
    known = told.select("graph_id", "term").distinct()
    held = nodes.select("graph_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).join(known, ["graph_id", "term"], "left_semi")
    idf = inverse_frequencies(held, nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_texts")), ["graph_id"])
    unit = unit_weights(told, idf, ["graph_id"], ["graph_id", "node_id"])
    x = pairs.join(unit.select("graph_id", F.col("node_id").alias("a"), "term", F.col("u").alias("ua")), ["graph_id", "a"])
    both = x.join(unit.select("graph_id", F.col("node_id").alias("b"), "term", F.col("u").alias("ub")), ["graph_id", "b", "term"])
    alike = both.groupBy("graph_id", "a", "b").agg(F.round(F.sum(F.col("ua") * F.col("ub")), 6).alias("cosine"))
    found = pairs.join(alike, ["graph_id", "a", "b"], "left").where(F.coalesce("cosine", F.lit(0.0)) < likeness)
    return found.select("graph_id", F.col("a").alias("node_a"), F.col("b").alias("node_b"), "n_shared")


def discoveries(nodes: DataFrame, undirected: DataFrame, top: int = 20, per_domain: int | None = None) -> DataFrame:
    """(graph_id, node_a, node_b, n_bridges, surprise): the `top` pairs of every graph across domains with two or more shared names and no edge.

    All nodes take part, or with per_domain the first so many of each domain by
    ord. Two nodes with two names in common share one besides the most common
    name of either, so they meet, in blocks, over all names of a node but that.
    Surprise is 0.2 for each shared name, 0.9 at most; ties go by node ids.
    """
    rows = content_only(nodes).select("graph_id", "node_id", "ord", "entities", domain(F.col("source.file")).alias("domain")).where("domain is not null")
    if per_domain is not None:
        first = Window.partitionBy("graph_id", "domain").orderBy("ord", "node_id")
        rows = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_domain).drop("n")
    needed = needed_names(rows, 0.0, 2).select("graph_id", "name", "n", "names", "ord", "node_id").join(rows.select("graph_id", "node_id", "domain"), ["graph_id", "node_id"])
    item = needed.select("graph_id", "name", "n", F.struct("node_id", "domain", "names").alias("item"))
    met = met_in_blocks(item, ["graph_id", "name"], n="n").where("x.domain <> y.domain")
    bridges = F.size(F.array_intersect("x.names", "y.names")).cast("long")
    shared = met.select("graph_id", F.col("x.node_id").alias("node_a"), F.col("y.node_id").alias("node_b"), bridges.alias("n_bridges")).where("n_bridges >= 2").distinct()
    tied = undirected.select("graph_id", F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"))
    shared = shared.join(tied, ["graph_id", "node_a", "node_b"], "left_anti").withColumn("surprise", F.least(F.round(F.col("n_bridges") * 0.2, 6), F.lit(0.9)))
    best = Window.partitionBy("graph_id").orderBy(F.desc("surprise"), "node_a", "node_b")
    return shared.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top).drop("n")


def decayed_confidence(confidence: Column, last_access: Column, as_of: Column) -> Column:
    """Confidence after idle time: from the eighth day it loses a hundredth of itself a day, half at most, and stays above 0.1."""
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_access.cast("timestamp"))) / 86_400_000_000
    lower = confidence * F.greatest(F.lit(0.5), 1 - (days - 7) * 0.01)
    return F.when((days > 7) & (lower < confidence), F.greatest(F.lit(0.1), lower)).otherwise(confidence)


def confidence_decay(nodes: DataFrame, as_of: str) -> DataFrame:
    """(graph_id, node_id, confidence, decayed): the content nodes that lose confidence; never accessed ones count from their creation."""
    rows = content_only(nodes).where(F.col("node_type") != "person")
    now = F.lit(as_of).cast("timestamp_ntz")
    lower = decayed_confidence(F.col("confidence"), F.coalesce("last_accessed_at", "created_at"), now)
    return rows.select("graph_id", "node_id", "confidence", F.round(lower, 6).alias("decayed")).where("decayed < confidence")


def inferred_edges(directed: DataFrame, least: float = 0.15, most: int = 100) -> DataFrame:
    """(graph_id, from_node, to_node, edge_type, weight): per graph up to `most` edges that two of one transitive type imply.

    A to B and B to C of one type imply A to C with half the product of the
    weights, unless it is below `least`, a loop, or an edge from A to C exists.
    Of several ways the strongest counts; the cap takes the strongest edges.
    An edge takes part if it can pass `least` with the strongest one that meets
    it in the middle; the edges of a node with very many of them meet in slices.
    """
    held = directed.where(F.col("edge_type").isin(TRANSITIVE) & F.col("weight").isNotNull()).select("graph_id", "from_node", "to_node", "edge_type", "weight")
    most_weight = lambda end: held.groupBy("graph_id", F.col(end).alias("mid"), "edge_type").agg(F.max("weight").alias("best"))
    able = lambda df, end: df.join(most_weight(end), ["graph_id", "mid", "edge_type"]).where(F.col("best") * F.col("weight") * 0.5 >= least - 1e-6).drop("best")
    onward = able(held.select("graph_id", F.col("from_node").alias("mid"), F.col("to_node").alias("end"), "edge_type", "weight"), "to_node").withColumnRenamed("weight", "w2")
    ways = join_sliced(able(held.withColumnRenamed("to_node", "mid"), "from_node"), onward, ["graph_id", "mid", "edge_type"]).where("from_node <> end")
    ways = ways.withColumn("weight", six(F.col("weight") * F.col("w2") * 0.5)).where(F.col("weight") >= least)
    best = ways.groupBy("graph_id", "from_node", F.col("end").alias("to_node")).agg(F.max(F.struct("weight", "edge_type")).alias("b"))
    best = best.select("graph_id", "from_node", "to_node", "b.edge_type", "b.weight")
    new = best.join(directed.select("graph_id", "from_node", "to_node").distinct(), ["graph_id", "from_node", "to_node"], "left_anti")
    order = Window.partitionBy("graph_id").orderBy(F.desc("weight"), "from_node", "to_node")
    return new.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
