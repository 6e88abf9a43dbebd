"""Corrections and forgetting: change rows in, changed rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import chunks, correction_type, entities
from knotwork.operators.graph import closure, content_only, new_edge_id
from knotwork.sources.texts import markdown_sections


def stamped(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def corrected_nodes(nodes: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """nodes (graph_id, node_id, content, entities, confidence, valid_until) after changes (node_id, kind, content, reason).

    edit: new content and names, confidence 1. delete: expired now, confidence
    0.1. supersede: expired now, confidence 0.3 at most. add leaves its node as it
    is. Of several changes of one node the one of the largest (kind, content)
    counts; changes without a node, or edits without content, change nothing.
    """
    usable = changes.where(F.col("node_id").isNotNull() & (F.col("kind").isin("delete") | F.col("content").isNotNull()) & (F.col("kind") != "add"))
    one = usable.groupBy("node_id").agg(F.max(F.struct("kind", "content")).alias("c"))
    both = nodes.join(one, "node_id", "left")
    kind, text = F.col("c.kind"), F.col("c.content")
    return both.select(
        "graph_id", "node_id",
        F.when(kind == "edit", text).otherwise(F.col("content")).alias("content"),
        F.when(kind == "edit", entities(text)).otherwise(F.col("entities")).alias("entities"),
        F.when(kind == "edit", 1.0).when(kind == "delete", 0.1).when(kind == "supersede", F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(kind.isin("delete", "supersede"), stamped(as_of)).otherwise(F.col("valid_until")).alias("valid_until"),
        F.coalesce(kind, F.lit("none")).alias("change"),
    )


def added_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(graph_id, node_id, content, node_type, confidence, replaces): the nodes that add and supersede changes bring."""
    new = changes.where(F.col("kind").isin("add", "supersede") & F.col("content").isNotNull())
    at = nodes.select("graph_id", F.col("node_id").alias("old"))
    new = new.withColumnRenamed("node_id", "old").join(at, "old", "left").where("kind = 'add' or graph_id is not null")
    return new.select(
        "graph_id", new_edge_id(F.coalesce("graph_id", F.lit("")), "kind", F.coalesce("old", F.lit("")), "content").alias("node_id"), "content",
        correction_type(F.col("content")).alias("node_type"), F.lit(1.0).alias("confidence"), F.when(F.col("kind") == "supersede", F.col("old")).alias("replaces"),
        F.when(F.col("kind") == "add", F.col("old")).alias("supports"),
    ).distinct()


def correction_edges(added: DataFrame) -> DataFrame:
    """(graph_id, from_node, to_node, edge_type, weight): supersedes edges of new versions and supports edges of additions."""
    old = added.where("replaces is not null").select("graph_id", F.col("replaces").alias("from_node"), F.col("node_id").alias("to_node"), F.lit("supersedes").alias("edge_type"), F.lit(1.0).alias("weight"))
    more = added.where("supports is not null").select("graph_id", F.col("supports").alias("from_node"), F.col("node_id").alias("to_node"), F.lit("supports").alias("edge_type"), F.lit(0.9).alias("weight"))
    return old.unionByName(more)


def remembered(nodes: DataFrame, as_of: str) -> DataFrame:
    """Content nodes that are not forgotten yet."""
    return content_only(nodes).where(F.col("valid_until").isNull() | (F.col("valid_until") >= stamped(as_of)))


def forgotten_by_time(nodes: DataFrame, before: str, as_of: str) -> DataFrame:
    """(graph_id, node_id, valid_until, confidence) of the content nodes created before a time, as forgetting leaves them."""
    rows = remembered(nodes, as_of).where(F.col("created_at") < stamped(before))
    return rows.select("graph_id", "node_id", stamped(as_of).alias("valid_until"), F.lit(0.1).alias("confidence"))


def on_topic(topic: str) -> Column:
    """Whether a node names a topic or speaks of it, in any case."""
    low = topic.lower()
    named = F.coalesce(F.exists("entities", lambda e: F.contains(F.lower(e), F.lit(low))), F.lit(False))
    return named | F.coalesce(F.contains(F.lower("content"), F.lit(low)), F.lit(False))


def forgotten_by_topic(nodes: DataFrame, topic: str, as_of: str) -> DataFrame:
    """(graph_id, node_id, valid_until, confidence) of the content nodes on a topic, as forgetting leaves them."""
    rows = remembered(nodes, as_of).where(on_topic(topic))
    return rows.select("graph_id", "node_id", stamped(as_of).alias("valid_until"), F.lit(0.1).alias("confidence"))


def cascade(nodes: DataFrame, directed: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph_id, root, node_id): what goes with a deleted node: what it contains, directly or not, and its file's nodes with what those contain."""
    at = roots.select("graph_id", F.col("node_id").alias("root"))
    files = nodes.select("graph_id", "node_id", F.col("source.file").alias("file"))
    own = at.join(files.select("graph_id", F.col("node_id").alias("root"), "file"), ["graph_id", "root"])
    peers = own.join(files, ["graph_id", "file"]).select("graph_id", "root", "node_id")
    starts = peers.unionByName(at.select("graph_id", "root", F.col("root").alias("node_id"))).distinct()
    below = closure(directed.where("edge_type = 'contains'"), starts.select("graph_id", "node_id").distinct())
    reached = starts.join(below.withColumnRenamed("node_id", "child").withColumnRenamed("root", "node_id"), ["graph_id", "node_id"])
    held = nodes.select("graph_id", "node_id")
    return reached.select("graph_id", "root", F.col("child").alias("node_id")).distinct().join(held, ["graph_id", "node_id"], "left_semi").where("root <> node_id")


def changes_from_markdown(df: DataFrame, key: str, text: str, least_chars: int = 20) -> DataFrame:
    """(node_id, kind, content, reason): one add for every chunk of markdown texts with least_chars characters, each content once."""
    pieces = markdown_sections(df, key, text).select(key, F.explode(chunks(F.col("content"))).alias("content")).where(F.length("content") >= least_chars)
    reason = F.concat(F.lit("imported from "), F.min(F.col(key).cast("string")))
    return pieces.groupBy("content").agg(reason.alias("reason")).select(F.lit(None).cast("string").alias("node_id"), F.lit("add").alias("kind"), "content", "reason")
