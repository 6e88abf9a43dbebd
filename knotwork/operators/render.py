"""Texts made of report rows: one text for each question, graph or topic, put together where the rows lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import STRUCTURAL
from knotwork.operators.reports import DIRECTED_MARKS, HEADING, PARTS, UNDIRECTED_MARKS


def shown(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves away from zero."""
    return x.cast(f"decimal(20,{digits})").cast("string")


def lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the lines of every key, in the order of part and place. Every key has a bounded number of lines."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.array_join(each, "\n").alias("text"))


def part(df: DataFrame, keys: list[str], number: int, place: Column | str, line: Column) -> DataFrame:
    return df.select(*keys, F.lit(number).alias("part"), (F.col(place) if isinstance(place, str) else place).cast("string").alias("place"), line.alias("line"))


def subgraph_texts(best: DataFrame, nodes: DataFrame, directed: DataFrame, undirected: DataFrame, key: str) -> DataFrame:
    """(key, text): the chosen nodes (key, graph_id, node_id, score, place) of every question and the edges between them, under short names.

    directed and undirected hold the key and both ends, as edges_between gives them.
    """
    names = best.select(key, "graph_id", "node_id", F.concat(F.lit("n"), F.col("place").cast("string")).alias("name"))
    counts = best.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    for i, df in enumerate((directed, undirected)):
        counts = counts.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(f"e{i}")), key, "left")
    edges = F.coalesce("e0", F.lit(0)) + F.coalesce("e1", F.lit(0))
    a, b, c = HEADING.split("{}")
    head = F.concat(F.lit(a), F.col("n").cast("string"), F.lit(b), edges.cast("string"), F.lit(c))
    held = best.join(nodes.select("graph_id", "node_id", "node_type", "content", F.col("source.section").alias("section"), "metadata"), ["graph_id", "node_id"])
    meta = F.col("metadata")
    tag = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"|{name}:"), c)).otherwise("")
    label = lambda kind: F.concat(F.lit("[n"), F.col("place").cast("string"), F.lit("|"), kind, F.lit("|"), shown(F.col("score"), 2))
    order = F.lpad(F.col("place").cast("string"), 9, "0")
    claims = F.slice(F.filter(F.transform(F.split(meta["claims"], r" \|\| "), lambda c: F.trim(c)), lambda c: c != ""), 1, 10)
    claimed = F.when(F.size(claims) > 0, F.concat(F.lit("\n  claims: "), F.array_join(claims, " | "))).otherwise("")
    summary = F.concat(label(F.lit("summary")), tag("session", meta["session_id"]), tag("date", meta["session_date"]), F.lit("] "), F.coalesce("content", F.lit("")), claimed)
    fact = F.concat(label(F.coalesce("node_type", F.lit("fact"))), tag("src", F.col("section")), tag("date", meta["session_date"]), F.lit("] "), F.coalesce("content", F.lit("")))
    sums = held.where("node_type = 'session-summary'")
    facts = held.where(F.col("node_type").isNull() | ~F.col("node_type").isin(*STRUCTURAL, "session-summary"))
    rows = part(counts, [key], 0, F.lit(""), head)

    def titled(df: DataFrame, number: int, place: Column, line: Column) -> DataFrame:
        title = part(df.select(key).distinct(), [key], number, F.lit(""), F.lit(f"\n{PARTS[number - 1]}"))
        return title.unionByName(part(df, [key], number, place, line))

    rows = rows.unionByName(titled(sums, 1, order, summary)).unionByName(titled(facts, 2, order, fact))
    for number, df, ends, marks in ((3, directed, ("from_node", "to_node"), DIRECTED_MARKS), (4, undirected, ("node_a", "node_b"), UNDIRECTED_MARKS)):
        x = df.join(names.select(key, "graph_id", F.col("node_id").alias(ends[0]), F.col("name").alias("x")), [key, "graph_id", ends[0]]).join(names.select(key, "graph_id", F.col("node_id").alias(ends[1]), F.col("name").alias("y")), [key, "graph_id", ends[1]])
        line = F.concat("x", F.lit(f" {marks[0]}"), "edge_type", F.lit(":"), F.coalesce(shown(F.col("weight"), 1), F.lit("?")), F.lit(f"{marks[1]} "), "y")
        rows = rows.unionByName(titled(x, number, F.concat_ws("|", *ends, "edge_type"), line))
    return lines(rows, [key])


def topic_pages(page: DataFrame, nodes: DataFrame, relations: DataFrame, topic: str) -> DataFrame:
    """(graph_id, text): a page on a topic for every graph that knows it, by kinds of nodes, events by year."""
    held = page.join(nodes.select("graph_id", "node_id", "content", "confidence", F.col("source.file").alias("file")), ["graph_id", "node_id"])
    cite = F.concat(F.lit(" ^[node:"), "node_id", F.lit("]^"))
    text = lambda n: F.coalesce(F.left("content", F.lit(n)), F.lit(""))
    order = F.lpad(F.col("place").cast("string"), 9, "0")
    kinds = [
        ("definition", "What it is", text(400), order), ("person", "People", text(200), order),
        ("event", "Timeline", F.concat(F.coalesce(F.concat(F.col("year").cast("string"), F.lit(": ")), F.lit("")), text(200)), F.concat(F.lpad(F.coalesce("year", F.lit(9999)).cast("string"), 4, "0"), order)),
        ("fact", "Facts", text(250), order), ("data-point", "Figures", text(200), order), ("claim", "Claims", F.concat(text(200), F.lit(" ("), shown(F.col("confidence") * 100, 0), F.lit(" %)")), order),
    ]
    rows = part(page.select("graph_id").distinct(), ["graph_id"], 0, F.lit(""), F.lit(f"# {topic}"))
    for i, (kind, title, line, place) in enumerate(kinds, 1):
        of = held.where(F.col("node_type") == kind)
        rows = rows.unionByName(part(of.select("graph_id").distinct(), ["graph_id"], i, F.lit(""), F.lit(f"\n## {title}\n"))).unionByName(part(of, ["graph_id"], i, place, F.concat(F.lit("- "), line, cite)))
    tied = relations.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc_nulls_last("weight"), "edge_id"))).where("k <= 50")
    line = F.concat(F.lit('- "'), F.coalesce("from_label", F.lit("")), F.lit('" '), "edge_type", F.lit(' "'), F.coalesce("to_label", F.lit("")), F.lit('" ('), F.coalesce(shown(F.col("weight"), 2), F.lit("?")), F.lit(")"))
    rows = rows.unionByName(part(tied.select("graph_id").distinct(), ["graph_id"], 8, F.lit(""), F.lit("\n## Relations\n"))).unionByName(part(tied, ["graph_id"], 8, F.lpad(F.col("k").cast("string"), 9, "0"), line))
    files = held.select("graph_id", "file").distinct()
    rows = rows.unionByName(part(files.select("graph_id").distinct(), ["graph_id"], 9, F.lit(""), F.lit("\n## Sources\n"))).unionByName(part(files, ["graph_id"], 9, "file", F.concat(F.lit("- "), "file")))
    return lines(rows, ["graph_id"])


def audit_texts(health: DataFrame, entities: DataFrame, gaps: DataFrame, facts: DataFrame, contradictions: DataFrame, discoveries: DataFrame, nodes: DataFrame, top: int = 30) -> DataFrame:
    """(graph_id, text): what an audit finds, for every graph: health, the `top` entities with three facts each, contradictions, ten discoveries, and what is mentioned only once.

    facts (graph_id, name, fact_no, content, node_type) and the pairs
    (graph_id, node_a, node_b) come from the reports; texts of pairs are cut to
    200 and 100 characters.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    place = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    about = F.concat(
        F.lit("# Audit of "), "graph_id", F.lit("\n\nNodes "), number("n_nodes"), F.lit(", edges "), (F.col("n_directed") + F.col("n_undirected")).cast("string"), F.lit(", orphans "), number("n_orphans"),
        F.lit(", weak "), number("n_weak"), F.lit(", expired "), number("n_expired"), F.lit(", enriched "), number("n_enriched"), F.lit(", mean confidence "), number("mean_confidence"),
    )
    rows = part(health, ["graph_id"], 0, F.lit(""), about)

    def titled(df: DataFrame, number: int, title: str, at: Column, line: Column) -> DataFrame:
        heading = part(df.select("graph_id").distinct(), ["graph_id"], number, F.lit(""), F.lit(f"\n## {title}\n"))
        return heading.unionByName(part(df, ["graph_id"], number, at, line))

    ranked = entities.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("fact_count"), "name"))).where(F.col("k") <= top)
    line = F.concat(F.lit("- "), "name", F.lit(": "), number("fact_count"), F.lit(" facts, "), number("n_sources"), F.lit(" sources, "), number("access_count"), F.lit(" accesses, "), "confidence_trend")
    rows = rows.unionByName(titled(ranked, 1, "Entities", place("k"), line))
    told = facts.where("fact_no <= 3").join(ranked.select("graph_id", "name", "k"), ["graph_id", "name"])
    line = F.concat(F.lit("  - ["), F.coalesce("node_type", F.lit("fact")), F.lit("] "), F.left(F.coalesce("content", F.lit("")), F.lit(150)))
    rows = rows.unionByName(part(told, ["graph_id"], 1, F.concat(place("k"), F.col("fact_no").cast("string")), line))
    said = lambda c: nodes.select("graph_id", F.col("node_id").alias(f"node_{c}"), F.coalesce("content", F.lit("")).alias(f"text_{c}"), F.coalesce("source.file", F.lit("")).alias(f"file_{c}"))
    both = lambda df: df.join(said("a"), ["graph_id", "node_a"]).join(said("b"), ["graph_id", "node_b"])
    line = F.concat(F.lit("- A: "), F.left("text_a", F.lit(200)), F.lit("\n  B: "), F.left("text_b", F.lit(200)))
    rows = rows.unionByName(titled(both(contradictions), 2, "Contradictions", F.concat_ws("|", "node_a", "node_b"), line))
    best = discoveries.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("surprise"), "node_a", "node_b"))).where("k <= 10")
    line = F.concat(F.lit("- "), number("n_bridges"), F.lit(" bridges (surprise "), shown(F.col("surprise") * 100, 0), F.lit(" %)\n  - "), "file_a", F.lit(": "), F.left("text_a", F.lit(100)), F.lit("\n  - "), "file_b", F.lit(": "), F.left("text_b", F.lit(100)))
    rows = rows.unionByName(titled(both(best), 3, "Discoveries", place("k"), line))
    return lines(rows.unionByName(titled(gaps, 4, "Mentioned once", F.col("entity"), F.concat(F.lit("- "), "entity"))), ["graph_id"])


def index_pages(nodes: DataFrame, top: int = 30, most: int = 40) -> DataFrame:
    """(graph_id, text): an index of topics for every graph: the `top` names by mentions, then persons, `most` in all, with how many nodes name each."""
    named = nodes.select("graph_id", F.explode(F.array_distinct("entities")).alias("topic")).groupBy("graph_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    ranked = named.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("n"), "topic")))
    first = ranked.where(F.col("k") <= top).select("graph_id", "topic", "n", F.lit(0).alias("of"))
    persons = nodes.where("node_type = 'person' and content is not null").select("graph_id", F.col("content").alias("topic")).distinct().join(first.select("graph_id", "topic"), ["graph_id", "topic"], "left_anti")
    persons = persons.join(named, ["graph_id", "topic"], "left").select("graph_id", "topic", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("of"))
    listed = first.unionByName(persons).withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy("of", F.desc("n"), "topic"))).where(F.col("k") <= most)
    slug = F.regexp_replace(F.lower("topic"), "[^a-z0-9]+", "-")
    head = listed.groupBy("graph_id").agg(F.concat(F.lit("# Topics of "), F.first("graph_id"), F.lit("\n\n## Pages ("), F.count(F.lit(1)).cast("string"), F.lit(")\n")).alias("head"))
    line = F.concat(F.lit("- ["), "topic", F.lit("]("), slug, F.lit(".md), "), F.col("n").cast("string"), F.lit(" nodes"))
    return lines(part(head, ["graph_id"], 0, F.lit(""), F.col("head")).unionByName(part(listed, ["graph_id"], 1, F.lpad(F.col("k").cast("string"), 9, "0"), line)), ["graph_id"])
