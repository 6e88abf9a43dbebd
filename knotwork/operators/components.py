"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.spread import crowded, join_checked
from knotwork.session import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b", floor: int = 50_000) -> DataFrame:
    """(id, component) of every end of links; the component is the smallest id that it holds.

    Alternates large-star and small-star steps: each round ties the neighbours
    of a node to the smallest one, by grouping and joining, until the edges no
    longer change, however many rounds that takes. The number of rounds grows with the logarithm of the length
    of the chains. A node with very many neighbours, as the centre of a star
    becomes, is joined apart from the others. Null ends and self-links add nothing but the node itself.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = links.select(F.col("u").alias("id")).union(links.select(F.col("v").alias("id"))).distinct()
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_checked(both, low, ["u"], crowded(both, ["u"], floor)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = join_checked(large, low, ["u"], crowded(large, ["u"], floor)).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(tied.where("u <> v").distinct(), "small-star")
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
