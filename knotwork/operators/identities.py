"""Persons in the graph and what users speak about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import domain, likely_person, one_spaced
from knotwork.operators.graph import new_edge_id
from knotwork.operators.spread import next_in_group

#: Roles that may stand near a name. Fixed values.
ROLES = ["professor", "dr.", "researcher", "scientist", "engineer", "mathematician", "inventor", "pioneer", "founder", "ceo", "cto", "president", "director", "manager", "lead"]


def mentions(nodes: DataFrame) -> DataFrame:
    """(graph_id, name, node_id, ord, created_at): every mention of a likely person, once for each node."""
    each = nodes.select("graph_id", "node_id", "ord", "created_at", F.explode("entities").alias("entity"))
    return each.where(likely_person(F.col("entity"))).select("graph_id", one_spaced(F.col("entity")).alias("name"), "node_id", "ord", "created_at").distinct()


def persons(found: DataFrame, least: int = 2) -> DataFrame:
    """(graph_id, name, person_id, n_mentions, first_seen, last_seen, confidence): persons with `least` mentions in a graph."""
    rows = found.groupBy("graph_id", "name").agg(F.count(F.lit(1)).alias("n_mentions"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    rows = rows.where(F.col("n_mentions") >= least)
    confidence = F.least(F.round(0.5 + F.col("n_mentions") * 0.1, 6), F.lit(0.95))
    return rows.withColumns({"person_id": new_edge_id("graph_id", "name"), "confidence": confidence})


def person_edges(found: DataFrame, known: DataFrame) -> DataFrame:
    """(graph_id, from_node, to_node, edge_type, weight, evidence): cites edges from the mentioning nodes to the person's."""
    rows = found.join(known.select("graph_id", "name", "person_id"), ["graph_id", "name"])
    return rows.select(
        "graph_id", F.col("node_id").alias("from_node"), F.col("person_id").alias("to_node"), F.lit("cites").alias("edge_type"), F.lit(0.6).alias("weight"), F.concat(F.lit("Mentions "), "name").alias("evidence")
    )


def person_links(found: DataFrame, known: DataFrame, ahead: int = 4) -> DataFrame:
    """(graph_id, node_a, node_b): nodes that mention a person with the next `ahead` that do."""
    rows = found.join(known.select("graph_id", "name"), ["graph_id", "name"])
    rows = next_in_group(rows, ["graph_id", "name"], ["ord", "node_id"], "node_id", ahead)
    return rows.select("graph_id", F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b")).distinct()


def person_relations(found: DataFrame, known: DataFrame) -> DataFrame:
    """(graph_id, name_a, name_b, n_nodes, weight): persons of a graph that nodes mention together."""
    rows = found.join(known.select("graph_id", "name"), ["graph_id", "name"]).select("graph_id", "node_id", "name")
    other = rows.withColumnRenamed("name", "name_b")
    pairs = rows.join(other, ["graph_id", "node_id"]).where("name < name_b").groupBy("graph_id", F.col("name").alias("name_a"), "name_b").agg(F.count(F.lit(1)).alias("n_nodes"))
    return pairs.withColumn("weight", F.least(F.round(0.3 + F.col("n_nodes") * 0.1, 6), F.lit(0.9)))


def person_roles(found: DataFrame, known: DataFrame, nodes: DataFrame, around: int = 100, most: int = 10) -> DataFrame:
    """(graph_id, name, role): the first role within `around` characters of a name, in its first `most` mentions."""
    place = Window.partitionBy("graph_id", "name").orderBy("ord", "node_id")
    rows = found.join(known.select("graph_id", "name"), ["graph_id", "name"]).withColumn("n", F.row_number().over(place)).where(F.col("n") <= most)
    rows = rows.join(nodes.select("graph_id", "node_id", F.lower("content").alias("text")), ["graph_id", "node_id"])
    at = F.expr("locate(lower(name), text)")
    near = F.substring(F.col("text"), F.greatest(at - around, F.lit(1)), F.length("name") + around + F.least(at - 1, F.lit(around)))
    role = F.regexp_extract(near, "(" + "|".join(r.replace(".", r"\.") for r in ROLES) + ")", 1)
    rows = rows.where(at > 0).withColumn("role", role).where("role <> ''")
    return rows.groupBy("graph_id", "name").agg(F.min_by("role", "n").alias("role"))


def user_preferences(nodes: DataFrame, top: int = 20) -> DataFrame:
    """(graph_id, entity, n, place): what the user's messages of a graph name most."""
    said = nodes.where(F.lower(F.col("metadata")["role"]) == "user").select("graph_id", F.explode("entities").alias("entity"))
    counts = said.groupBy("graph_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("graph_id").orderBy(F.desc("n"), "entity")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def person_content(name: Column, role: Column, organisation: Column) -> Column:
    """What a person's node says: the name, the role in brackets and the organisation, where they are known."""
    return F.concat_ws(" ", name, F.concat(F.lit("("), role, F.lit(")")), F.concat(F.lit("at "), organisation))


def person_nodes(known: DataFrame, roles: DataFrame) -> DataFrame:
    """(graph_id, node_id, content, confidence): the node of every person, with the role that the texts give."""
    both = known.join(roles, ["graph_id", "name"], "left")
    return both.select("graph_id", F.col("person_id").alias("node_id"), person_content(F.col("name"), F.col("role"), F.lit(None).cast("string")).alias("content"), "confidence")


def user_domains(nodes: DataFrame, top: int = 10) -> DataFrame:
    """(graph_id, domain, n, place): the domains that the user's messages of a graph come from most."""
    said = nodes.where(F.lower(F.col("metadata")["role"]) == "user").select("graph_id", domain(F.col("source.file")).alias("domain")).where("domain is not null")
    order = Window.partitionBy("graph_id").orderBy(F.desc("n"), "domain")
    return said.groupBy("graph_id", "domain").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
