"""Access events and what they do to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def access_stats(events: DataFrame, node: str, at: str) -> DataFrame:
    """(node, last_accessed_at, access_count): last access and number of accesses; also on a stream."""
    return events.where(F.col(node).isNotNull()).groupBy(node).agg(F.max(at).alias("last_accessed_at"), F.count(F.lit(1)).alias("access_count"))


def with_accesses(nodes: DataFrame, stats: DataFrame, node: str = "node_id") -> DataFrame:
    """nodes with accesses added: the later time, and the sum of the counts."""
    new = stats.select(node, F.col("last_accessed_at").alias("_at"), F.col("access_count").alias("_n"))
    both = nodes.join(new, node, "left")
    return both.withColumns({"last_accessed_at": F.greatest("last_accessed_at", "_at"), "access_count": F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))}).drop("_at", "_n")


def accesses_by_window(events: DataFrame, at: str, kind: str, width: str, slide: str | None = None) -> DataFrame:
    """(start, kind, n): accesses in tumbling or sliding windows; also on a stream with a watermark."""
    frame: Column = F.window(at, width, slide) if slide else F.window(at, width)
    return events.groupBy(frame.alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
