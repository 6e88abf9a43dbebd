"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.spread import hot_keys, join_spread
from knotwork.session import materialise


def stored_time(text: Column) -> Column:
    """A time stored as epoch milliseconds or as ISO text in UTC; null where it is neither."""
    epoch = F.when(text.rlike(r"^\s*-?\d+\s*$"), F.timestamp_millis(F.trim(text).try_cast("long")).cast("timestamp_ntz"))
    return F.coalesce(epoch, F.try_to_timestamp(text).cast("timestamp_ntz"))


def edge_ends(edges: DataFrame, edge_table: str, ends: list[str]) -> DataFrame:
    """The non-null ends of an edge table in long form, one row per end."""
    pairs = F.array(*[F.struct(F.lit(c).alias("end_name"), F.col(c).alias("key")) for c in ends])
    return edges.select(
        F.lit(edge_table).alias("edge_table"), "graph_id", "edge_id", F.col("created_at").cast("timestamp_ntz").alias("at"), F.explode(pairs).alias("e")
    ).select("edge_table", "graph_id", "edge_id", "at", "e.end_name", "e.key").where(F.col("key").isNotNull())


def dangling_references(nodes: DataFrame, edge_tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(edge_table, edge_id, end_name, reason, month_key) of every edge end without a usable node.

    edge_tables maps a table's name to the table and its end columns. The keys
    of nodes (parents) and of edge ends (children) are tagged and unioned in
    long form and grouped by graph and key; a group keeps the children's first
    and last time, the node's creation and deletion time and whether there is a
    node. Groups without a node, or whose times can conflict, are the suspects;
    the ends that name one are read again and given their reason:
    missing (no node of that id in the edge's graph), deleted (the node was
    deleted at or before the edge's time) or late (created after it).

    Null ends are no references; an edge without a graph names nothing and is
    missing; without a time only missing applies and month_key is none;
    redelivered nodes and edges count once; an empty node table makes all ends
    missing. Grouping combines before the shuffle, and suspects that hold a
    large share of all ends are joined by broadcast, at most 1,000 of them.
    """
    ends = None
    for name, (edges, columns) in edge_tables.items():
        part = edge_ends(edges, name, columns)
        ends = part if ends is None else ends.unionByName(part)
    time = "timestamp_ntz"
    deleted = stored_time(F.col("metadata")["deleted_at"])
    none = F.lit(None).cast(time)
    placed = ends.where(F.col("graph_id").isNotNull())
    parents = nodes.where(F.col("graph_id").isNotNull()).select(
        "graph_id", F.col("node_id").alias("key"), F.lit(True).alias("parent"), F.col("created_at").cast(time).alias("born"), deleted.alias("gone"),
        none.alias("first_at"), none.alias("last_at"), F.lit(0).cast("long").alias("n"),
    )
    children = placed.select(
        "graph_id", "key", F.lit(False).alias("parent"), none.alias("born"), none.alias("gone"), F.col("at").alias("first_at"), F.col("at").alias("last_at"),
        F.lit(1).cast("long").alias("n"),
    )
    groups = parents.unionByName(children).groupBy("graph_id", "key").agg(
        F.max("parent").alias("parent"), F.min("born").alias("born"), F.min("gone").alias("gone"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"),
    )
    lacking = ~F.col("parent")
    conflict = F.coalesce(F.col("gone") <= F.col("last_at"), F.lit(False)) | F.coalesce(F.col("born") > F.col("first_at"), F.lit(False))
    suspects = groups.where((F.col("n") > 0) & (lacking | conflict)).select("graph_id", "key", "born", "gone", (~lacking).alias("held"), "n")
    suspects = materialise(suspects, "suspects")
    total = suspects.agg(F.sum("n")).first()[0] or 0

    hot = hot_keys(suspects, total)
    named = join_spread(placed, suspects.drop("n"), ["graph_id", "key"], hot)
    homeless = ends.where(F.col("graph_id").isNull()).withColumns({"born": none, "gone": none, "held": F.lit(False)})
    named = named.unionByName(homeless)
    reason = F.when(~F.col("held"), "missing").when(F.col("gone") <= F.col("at"), "deleted").when(F.col("born") > F.col("at"), "late")
    return (
        named.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("edge_table", "edge_id", "end_name", "reason", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("none")).alias("month_key"))
        .distinct()
    )


def references_by_period(nodes: DataFrame, edge_tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(edge_table, month_key, end_name, reason, n_ends): how many ends are dangling, per table and month."""
    found = dangling_references(nodes, edge_tables)
    return found.groupBy("edge_table", "month_key", "end_name", "reason").agg(F.count(F.lit(1)).alias("n_ends"))
