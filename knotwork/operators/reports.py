"""Reports on the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import confidence_trend, first_year, same_case
from knotwork.operators.corrections import on_topic, stamped
from knotwork.operators.graph import content_only, linked_ids

#: Headings of the subgraph text and the marks around an edge. Fixed values.
HEADING = "=== KNOWLEDGE SUBGRAPH ({} nodes, {} edges) ==="
PARTS = ("--- SESSION SUMMARIES ---", "--- NODES ---", "--- DIRECTED ---", "--- UNDIRECTED ---")
DIRECTED_MARKS, UNDIRECTED_MARKS = ("-[", "]->"), ("~[", "]~")


def graph_stats(nodes: DataFrame, directed: DataFrame, undirected: DataFrame) -> DataFrame:
    """(graph_id, kind, type, n): nodes and edges of every graph by type."""
    count = lambda df, kind, c: df.groupBy("graph_id", F.lit(kind).alias("kind"), F.col(c).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "node", "node_type").unionByName(count(directed, "directed", "edge_type")).unionByName(count(undirected, "undirected", "edge_type"))


def even_mean(c: str) -> Column:
    """The mean to six decimals, with halves up whatever the order in which the values were added."""
    return F.floor(F.avg(c) * 1000000 + 0.500001) / 1000000


def graph_health(nodes: DataFrame, directed: DataFrame, undirected: DataFrame, as_of: str) -> DataFrame:
    """One row for every graph: node and edge counts, orphans, weak, expired and enriched nodes, and means."""
    linked = linked_ids(directed, undirected).withColumn("linked", F.lit(True))
    enriched = F.col("metadata")["synthesis"].isNotNull()
    rows = nodes.join(linked, ["graph_id", "node_id"], "left")
    health = rows.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("linked").isNull()).alias("n_orphans"), F.count_if(F.col("confidence") < 0.5).alias("n_weak"),
        F.count_if(F.col("valid_until") < stamped(as_of)).alias("n_expired"), F.count_if(enriched).alias("n_enriched"),
        F.count_if(~enriched & ~F.col("node_type").isin("document", "section")).alias("n_unenriched"),
        even_mean("confidence").alias("mean_confidence"), even_mean("access_count").alias("mean_accesses"),
    )
    for name, edges in (("n_directed", directed), ("n_undirected", undirected)):
        health = health.join(edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name)), "graph_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return health


def entity_counts(nodes: DataFrame) -> DataFrame:
    """(graph_id, entity, n): how many nodes of a graph name an entity."""
    return nodes.select("graph_id", F.explode(F.array_distinct("entities")).alias("entity")).groupBy("graph_id", "entity").agg(F.count(F.lit(1)).alias("n"))


def coverage_gaps(nodes: DataFrame, top: int = 20) -> DataFrame:
    """(graph_id, entity): per graph the first entities, by code point, that only one node names."""
    once = entity_counts(nodes).where("n = 1")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy("entity"))).where(F.col("k") <= top).select("graph_id", "entity")


def topics(nodes: DataFrame, top: int = 50) -> DataFrame:
    """(graph_id, entity, n, place): what content nodes name most."""
    order = Window.partitionBy("graph_id").orderBy(F.desc("n"), "entity")
    return entity_counts(content_only(nodes)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def entity_reports(nodes: DataFrame, least: int = 3, top: int = 100) -> DataFrame:
    """(graph_id, name, fact_count, n_sources, first_ingested, last_accessed, access_count, confidence_trend): per graph the entities that content nodes name most."""
    rows = content_only(nodes).select("graph_id", "source", "created_at", "last_accessed_at", "access_count", "confidence", F.explode(F.array_distinct("entities")).alias("name"))
    out = rows.groupBy("graph_id", "name").agg(
        F.count(F.lit(1)).alias("fact_count"), F.count_distinct("source.file").alias("n_sources"), F.min("created_at").alias("first_ingested"),
        F.max("last_accessed_at").alias("last_accessed"), F.sum("access_count").alias("access_count"), confidence_trend(F.round(F.avg("confidence"), 9)).alias("confidence_trend"),
    )
    order = Window.partitionBy("graph_id").orderBy(F.desc("fact_count"), "name")
    return out.where(F.col("fact_count") >= least).withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")


def entity_relationships(nodes: DataFrame, directed: DataFrame, reports: DataFrame, first: int = 5, most: int = 10) -> DataFrame:
    """(graph_id, name, target, edge_type, weight): per reported entity up to `most` edges to content from its first `first` nodes."""
    named = content_only(nodes).select("graph_id", "node_id", "ord", F.explode(F.array_distinct("entities")).alias("name")).join(reports.select("graph_id", "name"), ["graph_id", "name"])
    named = named.withColumn("k", F.row_number().over(Window.partitionBy("graph_id", "name").orderBy("ord", "node_id"))).where(F.col("k") <= first)
    out = named.join(directed.select("graph_id", F.col("from_node").alias("node_id"), "to_node", "edge_type", "weight", "edge_id"), ["graph_id", "node_id"])
    ends = content_only(nodes).select("graph_id", F.col("node_id").alias("to_node"), F.left("content", F.lit(80)).alias("target"))
    out = out.join(ends, ["graph_id", "to_node"]).withColumn("r", F.row_number().over(Window.partitionBy("graph_id", "name").orderBy("k", "edge_id")))
    return out.where(F.col("r") <= most).select("graph_id", "name", "target", "edge_type", "weight")


def entity_facts(nodes: DataFrame, reports: DataFrame, most: int = 20) -> DataFrame:
    """(graph_id, name, fact_no, content, node_type, file): the first `most` content nodes, by ord, of every reported entity."""
    named = content_only(nodes).select("graph_id", "node_id", "ord", "node_type", F.left("content", F.lit(300)).alias("content"), F.col("source.file").alias("file"), F.explode(F.array_distinct("entities")).alias("name"))
    rows = named.join(reports.select("graph_id", "name"), ["graph_id", "name"])
    rows = rows.withColumn("fact_no", F.row_number().over(Window.partitionBy("graph_id", "name").orderBy("ord", "node_id"))).where(F.col("fact_no") <= most)
    return rows.select("graph_id", "name", "fact_no", "content", "node_type", "file")


def related_persons(nodes: DataFrame, directed: DataFrame, reports: DataFrame) -> DataFrame:
    """(graph_id, name, person): the persons that edges tie to the nodes of a reported entity."""
    named = content_only(nodes).select("graph_id", "node_id", F.explode(F.array_distinct("entities")).alias("name")).join(reports.select("graph_id", "name"), ["graph_id", "name"])
    way = lambda a, b: directed.select("graph_id", F.col(a).alias("node_id"), F.col(b).alias("other"))
    ends = named.join(way("from_node", "to_node").unionAll(way("to_node", "from_node")), ["graph_id", "node_id"]).select("graph_id", "name", "other").distinct()
    persons = nodes.where("node_type = 'person'").select("graph_id", F.col("node_id").alias("other"), F.col("content").alias("person"))
    return ends.join(persons, ["graph_id", "other"]).select("graph_id", "name", "person").distinct()


def topic_page(nodes: DataFrame, topic: str, top: int = 50) -> DataFrame:
    """(graph_id, node_id, node_type, relevance, year, place): per graph the nodes that matter to a topic.

    Relevance: 0.5 for a name, 0.3 for the text, 0.8 more for a person of that
    name, 0.1 for a summary, all times confidence.
    """
    low = F.lit(topic.lower())
    named = F.coalesce(F.exists("entities", lambda e: F.contains(F.lower(e), low)), F.lit(False))
    said = F.coalesce(F.contains(F.lower("content"), low), F.lit(False))
    points = F.when(named, 0.5).otherwise(0.0) + F.when(said, 0.3).otherwise(0.0) + F.when(said & (F.col("node_type") == "person"), 0.8).otherwise(0.0)
    points = points + F.when(F.col("metadata")["synthesis"].isNotNull(), 0.1).otherwise(0.0)
    rows = content_only(nodes).select("graph_id", "node_id", "node_type", F.round(points * F.col("confidence"), 6).alias("relevance"), first_year(F.col("content")).alias("year"))
    order = Window.partitionBy("graph_id").orderBy(F.desc("relevance"), "node_id")
    return rows.where("relevance > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def topic_relations(page: DataFrame, directed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, edge_id, edge_type, weight, from_label, to_label): edges that touch a topic's nodes, without the structural ones."""
    ids = page.select("graph_id", "node_id")
    edges = directed.where(~F.col("edge_type").isin("contains", "precedes"))
    touch = edges.join(ids.withColumnRenamed("node_id", "from_node"), ["graph_id", "from_node"], "left_semi").unionByName(edges.join(ids.withColumnRenamed("node_id", "to_node"), ["graph_id", "to_node"], "left_semi")).dropDuplicates(["edge_id"])
    label = lambda c, n: nodes.select("graph_id", F.col("node_id").alias(c), F.left("content", F.lit(60)).alias(n))
    return touch.join(label("from_node", "from_label"), ["graph_id", "from_node"]).join(label("to_node", "to_label"), ["graph_id", "to_node"]).select("graph_id", "edge_id", "edge_type", "weight", "from_label", "to_label")


def degrees(directed: DataFrame, undirected: DataFrame) -> DataFrame:
    """(graph_id, node_id, degree): how many edge ends name a node."""
    ends = [directed.select("graph_id", F.explode(F.array("from_node", "to_node")).alias("node_id")), undirected.select("graph_id", F.explode(F.array("node_a", "node_b")).alias("node_id"))]
    return ends[0].unionAll(ends[1]).where("node_id is not null").groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))


def export_sample(nodes: DataFrame, degree: DataFrame, first: int = 10) -> DataFrame:
    """(graph_id, node_id, node_type, label, degree): the first nodes of every graph by ord, to look at an export."""
    rows = nodes.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy("ord", "node_id"))).where(F.col("k") <= first).join(degree, ["graph_id", "node_id"], "left")
    return rows.select("graph_id", "node_id", "node_type", F.left("content", F.lit(60)).alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))


def insights(best: DataFrame, nodes: DataFrame, least: float = 0.1) -> DataFrame:
    """(q, node_id, score, synthesis, context): the chosen nodes of at least `least` that a model has enriched."""
    rich = nodes.select("graph_id", "node_id", F.col("metadata")["synthesis"].alias("synthesis"), F.col("metadata")["context"].alias("context")).where("synthesis is not null")
    return best.where(F.col("score") >= least).join(rich, ["graph_id", "node_id"]).select("q", "node_id", "score", "synthesis", "context")


def enrichment_candidates(nodes: DataFrame, degree: DataFrame, least_chars: int = 30, top: int = 20) -> DataFrame:
    """(graph_id, node_id, priority, place): per graph the content nodes without a summary that most deserve one."""
    rows = content_only(nodes).where(F.col("metadata")["synthesis"].isNull() & (F.length("content") >= least_chars)).join(degree, ["graph_id", "node_id"], "left")
    worth = F.col("confidence") * (1 + F.col("access_count") * 0.1) * (1 + F.coalesce("degree", F.lit(0)) * 0.05)
    order = Window.partitionBy("graph_id").orderBy(F.desc("priority"), "node_id")
    rows = rows.select("graph_id", "node_id", F.round(worth, 6).alias("priority"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def neighbourhoods(chosen: DataFrame, directed: DataFrame, undirected: DataFrame, most: int = 8) -> DataFrame:
    """(graph_id, node_id, other, edge_type, direction, weight): the strongest edges of the chosen nodes, ties by edge id."""
    ids = chosen.select("graph_id", "node_id").distinct()
    way = lambda df, a, b, d: df.select("graph_id", F.col(a).alias("node_id"), F.col(b).alias("other"), "edge_type", F.lit(d).alias("direction"), "weight", "edge_id")
    ways = [way(directed, "from_node", "to_node", "out"), way(directed, "to_node", "from_node", "in"), way(undirected, "node_a", "node_b", "both"), way(undirected, "node_b", "node_a", "both")]
    rows = ways[0].unionAll(ways[1]).unionAll(ways[2]).unionAll(ways[3]).where("other is not null and weight is not null").join(ids, ["graph_id", "node_id"], "left_semi")
    order = Window.partitionBy("graph_id", "node_id").orderBy(F.desc("weight"), "edge_id", "direction")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k", "edge_id")


def communities(labels: DataFrame, nodes: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """(graph_id, label, n_members, entity, n): communities of `least` members and more with the names that their members bear most."""
    sizes = labels.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") >= least)
    named = labels.join(nodes.select("graph_id", "node_id", F.explode(same_case(F.col("entities"))).alias("entity")), ["graph_id", "node_id"])
    counts = named.groupBy("graph_id", "label", "entity").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("graph_id", "label").orderBy(F.desc("n"), "entity")
    best = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")
    return sizes.join(best, ["graph_id", "label"])


def links_for_view(nodes: DataFrame, directed: DataFrame, undirected: DataFrame) -> DataFrame:
    """(graph_id, source, target, edge_type, kind, weight): all links between nodes that exist."""
    rows = directed.select("graph_id", F.col("from_node").alias("source"), F.col("to_node").alias("target"), "edge_type", F.lit("directed").alias("kind"), "weight").unionByName(
        undirected.select("graph_id", F.col("node_a").alias("source"), F.col("node_b").alias("target"), "edge_type", F.lit("undirected").alias("kind"), "weight")
    )
    ids = nodes.select("graph_id", "node_id")
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    return rows.select("graph_id", "source", "target", "edge_type", "kind", "weight")
