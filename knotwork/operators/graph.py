"""The graph's tables: current rows, edge builders and upkeep."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import STRUCTURAL, content_hash, defined_term, links, same_case, tokens
from knotwork.operators.alike import ENDS, OTHER, OWN, VOCABULARY, best_alike
from knotwork.operators.index import inverse_frequencies
from knotwork.operators.spread import among, crowded, join_checked, next_in_group
from knotwork.session import materialise, ship


def current_nodes(nodes: DataFrame, *columns: str) -> DataFrame:
    """The last delivery of every node, with the given columns (all if none)."""
    newest = Window.partitionBy("graph_id", "node_id").orderBy(F.desc_nulls_last("last_accessed_at"), F.desc_nulls_last("access_count"))
    chosen = columns or nodes.columns
    rows = nodes.select(*dict.fromkeys(["graph_id", "node_id", "last_accessed_at", "access_count", *chosen]))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*chosen)


def current_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """Every edge once, with the given columns (all if none)."""
    return edges.select(*dict.fromkeys(["edge_id", *(columns or edges.columns)])).dropDuplicates(["edge_id"])


def content_only(nodes: DataFrame) -> DataFrame:
    """Nodes that are neither documents nor sections."""
    return nodes.where(F.col("node_type").isNull() | ~F.col("node_type").isin(STRUCTURAL))


def new_edge_id(*parts: Column | str) -> Column:
    """A deterministic id for a built edge."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def sections_of(nodes: DataFrame) -> DataFrame:
    return content_only(nodes).select("graph_id", F.col("source.file").alias("file"), F.col("source.section").alias("section"), "ord", "node_id")


def precedes_edges(nodes: DataFrame) -> DataFrame:
    """(graph_id, from_node, to_node, edge_type, weight): every content node of a section before the next one."""
    met = next_in_group(sections_of(nodes), ["graph_id", "file", "section"], ["ord", "node_id"], "node_id", 1)
    return met.select("graph_id", F.col("x").alias("from_node"), F.col("y").alias("to_node"), F.lit("precedes").alias("edge_type"), F.lit(0.8).alias("weight"))


def cooccurrence_edges(nodes: DataFrame, window: int = 3) -> DataFrame:
    """(graph_id, node_a, node_b, edge_type, weight): content nodes of a section with up to `window` that follow."""
    met = next_in_group(sections_of(nodes), ["graph_id", "file", "section"], ["ord", "node_id"], "node_id", window)
    return met.select("graph_id", F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b"), F.lit("co-occurs").alias("edge_type"), F.lit(0.4).alias("weight"))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """(graph_id, from_node, to_node, edge_type, weight): document to section, section to section below it, and section to content, by file and section title.

    A section lies below the nearest one before it in its file (by ord) whose
    metadata give a smaller depth, if there is one, else below the document. Of
    several sections with one title in a file the first by ord holds the content.
    """
    file, section, depth = F.col("source.file").alias("file"), F.col("source.section").alias("section"), F.try_element_at("metadata", F.lit("depth")).try_cast("int").alias("depth")
    rows = nodes.select("graph_id", "node_id", "node_type", "ord", "content", file, section, depth)
    heads = rows.where("node_type = 'section'")
    documents = rows.where("node_type = 'document'").groupBy("graph_id", "file").agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("from_node"))
    titled = heads.groupBy("graph_id", "file", "section").agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("from_node"))
    before = Window.partitionBy("graph_id", "file").orderBy("ord", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("depth") > d, F.max(F.when(F.col("depth") == d, F.struct("ord", "node_id"))).over(before)) for d in range(1, 6)]
    heads = heads.withColumn("above", F.greatest(*last)["node_id"])
    nested = heads.where("above is not null").select("graph_id", F.col("above").alias("from_node"), "node_id")
    below = heads.where("above is null").join(documents, ["graph_id", "file"])
    inside = content_only(rows).join(titled, ["graph_id", "file", "section"])
    both = nested.unionByName(below.select("graph_id", "from_node", "node_id")).unionByName(inside.select("graph_id", "from_node", "node_id"))
    return both.select("graph_id", "from_node", F.col("node_id").alias("to_node"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))


def cites_edges(nodes: DataFrame) -> DataFrame:
    """(graph_id, from_node, to_node, edge_type, weight): content to the first document or section whose title a link names.

    Titles and links agree without regard to case, with _ for a blank.
    """
    titles = nodes.where(F.col("node_type").isin(STRUCTURAL)).groupBy("graph_id", F.lower("content").alias("title")).agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("to_node"))
    asked = content_only(nodes).select("graph_id", F.col("node_id").alias("from_node"), F.explode(links(F.col("content"))).alias("link"))
    asked = asked.select("graph_id", "from_node", F.lower(F.replace("link", F.lit("_"), F.lit(" "))).alias("title")).distinct()
    return asked.join(titles, ["graph_id", "title"]).select("graph_id", "from_node", "to_node", F.lit("cites").alias("edge_type"), F.lit(0.7).alias("weight")).distinct()


def plain_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def defines_edges(nodes: DataFrame) -> DataFrame:
    """(graph_id, from_node, to_node, edge_type, weight): definitions to the other nodes that use the defined term.

    A node uses a term if its content holds the term's text, in any case, and
    all words of the term as words. Each term of a graph is looked for once, in
    the nodes that hold its rarest word; only the words that a term may need
    leave the scan, told by a bitmap of fixed size that lets some more through.
    """
    nodes = materialise(nodes.select("graph_id", "node_id", "node_type", "content"), "texts")
    defined = nodes.where(F.col("node_type") == "definition").select("graph_id", F.col("node_id").alias("from_node"), F.lower(defined_term(F.col("content"))).alias("defined"))
    defined = materialise(defined.where("defined is not null"), "defined")
    terms = defined.select("graph_id", "defined").distinct().withColumn("parts", plain_words(F.col("defined")))
    parts = terms.select("graph_id", "defined", F.explode("parts").alias("word"))
    said = nodes.select("graph_id", F.explode(plain_words(F.col("content"))).alias("word"))
    df = among(said, parts, ["graph_id", "word"]).groupBy("graph_id", "word").agg(F.count(F.lit(1)).alias("df"))
    rarest = parts.join(df, ["graph_id", "word"]).groupBy("graph_id", "defined").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    rarest = materialise(rarest, "rarest")
    held = among(nodes.select("graph_id", "node_id", F.lower("content").alias("text"), F.explode(plain_words(F.col("content"))).alias("word")), rarest, ["graph_id", "word"])
    uses = F.contains("text", "defined") & (F.size(F.array_except(plain_words(F.col("defined")), plain_words(F.col("text")))) == 0)
    met = held.join(rarest, ["graph_id", "word"]).where(uses).select("graph_id", "defined", "node_id")
    met = met.join(defined, ["graph_id", "defined"]).where("from_node <> node_id")
    return met.select("graph_id", "from_node", F.col("node_id").alias("to_node"), F.lit("defines").alias("edge_type"), F.lit(0.6).alias("weight"))


def similarity_edges(nodes: DataFrame, per_node: int = 10, similar: float = 0.3, shared: float = 0.2, early: float = 0.15, most_texts: int = 150_000) -> DataFrame:
    """(graph_id, node_a, node_b, edge_type, weight): content nodes of a graph that are alike.

    A pair is similar-to if the cosine of its term weights reaches `similar`,
    else shares-entity if the Jaccard share of its names reaches `shared` and it
    has a term in common. A pair stays if it is among the per_node best of both
    its ends, by weight, then ord; weights are rounded to 6 digits first.

    Every text meets every other of its graph, in tiles of a task, so that no
    pair is shuffled but those among the best of an end (see alike). A graph of
    more than most_texts texts, or with much of the work, is cut into an odd
    number of slices; a task has the texts of one slice and is passed those of
    the next half of the others. early has no say any more: nothing is left out
    beforehand.
    """
    hashed = lambda words: F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))
    names = F.filter(same_case(F.col("entities")), lambda e: e.isNotNull())
    texts = content_only(nodes).where("graph_id is not null").select("graph_id", "node_id", "ord", hashed(tokens(F.col("content"))).alias("terms"), hashed(names).alias("names"))
    texts = materialise(texts, "texts")
    sizes = materialise(texts.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_texts")), "sizes")
    counts = texts.select("graph_id", F.explode(F.array_distinct("terms")).alias("term"))
    idf = materialise(inverse_frequencies(counts, sizes, ["graph_id"]), "idf")
    work = sizes.agg(F.sum(F.col("n_texts") * F.col("n_texts"))).first()[0] or 1
    needed = F.greatest(F.ceil(F.col("n_texts") / most_texts), F.ceil(F.col("n_texts") * F.col("n_texts") * 6 / work))
    slices = sizes.select("graph_id", (needed + (needed + 1) % 2).cast("int").alias("slices"))
    parts = slices.agg(F.sum("slices")).first()[0] or 1
    several = F.broadcast(slices.where("slices > 1"))  # 6, and one for each most_texts texts, at most
    dealt = lambda df: df.join(several, "graph_id", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    known = dealt(idf).select("graph_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(VOCABULARY).alias("kind"), "slices", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("node_id"), F.array("term").alias("terms"), F.lit(None).cast("array<bigint>").alias("names"), "idf")
    steps = dealt(texts.where("node_id is not null")).withColumn("step", F.explode(F.sequence(F.lit(0), F.expr("slices div 2").cast("int"))))
    slice_of = F.pmod(F.pmod(F.xxhash64("node_id", "ord"), "slices") - F.col("step"), "slices").cast("int")
    rows = steps.select("graph_id", slice_of.alias("slice"), F.when(F.col("step") == 0, OWN).otherwise(OTHER).alias("kind"), "slices", "ord", "node_id", "terms", "names", F.lit(None).cast("double").alias("idf"))
    read = known.unionByName(rows).repartition(min(2 * parts, 10_000), "graph_id", "slice").sortWithinPartitions("graph_id", "slice", "kind", "ord", "node_id")
    ship(nodes.sparkSession)
    ends = materialise(read.mapInArrow(best_alike(per_node, similar, shared), ENDS), "ends")
    one, other = F.struct("ord", "node_id"), F.struct(F.col("other_ord").alias("ord"), F.col("other_id").alias("node_id"))
    best = Window.partitionBy("graph_id", "one").orderBy(F.desc("weight"), "other")
    open_ends = ends.where("not settled").select("graph_id", one.alias("one"), other.alias("other"), "edge_type", "weight")
    open_ends = open_ends.withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_node)
    pairs = open_ends.groupBy("graph_id", F.least("one", "other").alias("x"), F.greatest("one", "other").alias("y"), "edge_type", "weight").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2")
    pairs = ends.where("settled").select("graph_id", one.alias("x"), other.alias("y"), "edge_type", "weight").unionByName(pairs.drop("ends"))
    return pairs.select("graph_id", F.col("x.node_id").alias("node_a"), F.col("y.node_id").alias("node_b"), "edge_type", "weight")


def needed_names(nodes: DataFrame, least: float, at_least: int = 1) -> DataFrame:
    """(graph_id, ord, node_id, names, name, n): of every node's names, in one case and the rarest of its graph first, those of which two nodes share one if `least` of all their names, and at_least of them, are the same.

    n is how many nodes of the graph bear the name.
    """
    named = nodes.where(F.size("entities") >= at_least).select("graph_id", "ord", "node_id", same_case(F.col("entities")).alias("names"))
    each = named.select("*", F.explode("names").alias("name"))
    each = each.join(each.groupBy("graph_id", "name").agg(F.count(F.lit(1)).alias("n")), ["graph_id", "name"])
    rarest = Window.partitionBy("graph_id", "ord", "node_id").orderBy("n", "name")
    enough = F.greatest(F.ceil(F.size("names") * least - 1e-9), F.lit(at_least))
    return each.withColumn("_k", F.row_number().over(rarest)).where(F.col("_k") <= F.size("names") - enough + 1).drop("_k")


def duplicates(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, canonical_id): content nodes whose exact content an earlier node of the graph has."""
    texts = content_only(nodes).where("content is not null").select("graph_id", "node_id", "ord", content_hash(F.col("content")).alias("hash"))
    first = texts.groupBy("graph_id", "hash").agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("canonical_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return texts.join(first, ["graph_id", "hash"]).where("node_id <> canonical_id").select("graph_id", "node_id", "canonical_id")


def rewrite_ends(edges: DataFrame, merged: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """edges with duplicate nodes replaced by their canonical ones; edges that become loops leave."""
    for end in ends:
        names = merged.select("graph_id", F.col("node_id").alias(end), F.col("canonical_id").alias("_to"))
        edges = join_checked(edges, names, ["graph_id", end], crowded(edges, ["graph_id", end]), "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.where(F.col(ends[0]) != F.col(ends[1]))


def strong_edges(edges: DataFrame, least: float) -> DataFrame:
    """Edges of at least the given weight; a null weight is none."""
    return edges.where(F.col("weight") >= least)


def linked_ids(directed: DataFrame, undirected: DataFrame) -> DataFrame:
    """(graph_id, node_id) of every end of an edge, once."""
    ends = [directed.select("graph_id", F.col(c).alias("node_id")) for c in ("from_node", "to_node")]
    ends += [undirected.select("graph_id", F.col(c).alias("node_id")) for c in ("node_a", "node_b")]
    return ends[0].unionAll(ends[1]).unionAll(ends[2]).unionAll(ends[3]).where("node_id is not null").distinct()


def pruned_nodes(nodes: DataFrame, directed: DataFrame, undirected: DataFrame, least_directed: float = 0.1, least_undirected: float = 0.15) -> DataFrame:
    """nodes that an edge of enough weight still holds."""
    held = linked_ids(strong_edges(directed, least_directed), strong_edges(undirected, least_undirected))
    return nodes.join(held, ["graph_id", "node_id"], "left_semi")


def unseen(incoming: DataFrame, existing: DataFrame, text: str, scope: tuple[str, ...] = (), hashed: str | None = None) -> DataFrame:
    """Rows of incoming whose text existing does not hold, each text once (the first by its other columns that have an order).

    scope names columns, such as graph_id, within which texts are compared;
    hashed is the column of existing that holds the hash of its text already.
    Rows without a text are left out. Columns keep their values, maps too.
    """
    known = existing.where(F.col(text).isNotNull()).select(*scope, (F.col(hashed) if hashed else content_hash(F.col(text))).alias("_hash"))
    fresh = incoming.where(F.col(text).isNotNull()).withColumn("_hash", content_hash(F.col(text))).join(known, [*scope, "_hash"], "left_anti")
    kept = [c for c, kind in incoming.dtypes if "map<" not in kind]
    return fresh.groupBy(*scope, "_hash").agg(F.min_by(F.struct(*incoming.columns), F.struct(*kept)).alias("r")).select("r.*")


def closure(edges: DataFrame, roots: DataFrame, cut_after: int = 16) -> DataFrame:
    """(graph_id, root, node_id): everything that a root reaches over directed edges, roots included; safe on cycles.

    The rounds end when nothing new is reached, however long the chains are;
    every cut_after rounds the lineage is cut, and after the first of these, on
    long chains, a round follows eight edges.
    """
    hops = materialise(edges.select("graph_id", F.col("from_node").alias("node_id"), "to_node").where("node_id is not null and to_node is not null").distinct(), "hops")
    reached = materialise(roots.select("graph_id", F.col("node_id").alias("root"), "node_id").distinct(), "reached")
    frontier = reached
    for n in count(1):
        step, steps = frontier, None
        for _ in range(1 if n <= cut_after else 8):
            step = step.join(hops, ["graph_id", "node_id"]).select("graph_id", "root", F.col("to_node").alias("node_id")).distinct()
            steps = step if steps is None else steps.unionByName(step)
        frontier = materialise(steps.distinct().join(reached, ["graph_id", "root", "node_id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
        if n % cut_after == 0:
            reached = materialise(reached, "reached")


def label_rounds(edges: DataFrame, rounds: int = 10, nodes: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, label, settled): communities by label propagation over undirected edges, all nodes at once in every round.

    A node takes the label that most of its neighbours bear, the smallest of
    several; the first label is its own id. The rounds end when no label changes,
    or after `rounds`; settled tells whether the node's label stayed in the last
    round. With nodes (graph_id, node_id), edges count only if their graph holds
    both ends. Counts combine before the shuffle, so that a node with very many
    neighbours is no single group.
    """
    pairs = edges.select("graph_id", "node_a", "node_b").where("node_a is not null and node_b is not null and node_a <> node_b")
    for end in ("node_a", "node_b") if nodes is not None else ():
        pairs = pairs.join(nodes.select("graph_id", F.col("node_id").alias(end)).distinct(), ["graph_id", end], "left_semi")
    both = pairs.select("graph_id", "node_a", "node_b").union(pairs.select("graph_id", "node_b", "node_a")).toDF("graph_id", "node_id", "other")
    both = materialise(both, "neighbours")
    labels = both.select("graph_id", "node_id", F.col("node_id").alias("label"), F.lit(False).alias("settled")).distinct()
    hot = crowded(both, ["graph_id", "other"])
    for _ in range(rounds):
        votes = join_checked(both, labels.select("graph_id", F.col("node_id").alias("other"), "label"), ["graph_id", "other"], hot).groupBy("graph_id", "node_id", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("graph_id", "node_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        before = labels.select("graph_id", "node_id", F.col("label").alias("was"))
        labels = materialise(best.join(before, ["graph_id", "node_id"]).select("graph_id", "node_id", "b.label", (F.col("b.label") == F.col("was")).alias("settled")), "labels")
        if labels.where("not settled").isEmpty():
            break
    return labels


def community_nodes(labels: DataFrame, nodes: DataFrame, least: int = 3, names: int = 10, shortest: int = 3) -> tuple[DataFrame, DataFrame]:
    """(summaries, edges): a concept node of level 1 for every community of `least` members and more, and its contains edges of weight 0.7.

    summaries (graph_id, node_id, label, content, entities, n_members): the
    content names the five names that most members bear and the `shortest`
    contents of its members, 300 characters of them; names by number, then
    alphabet, contents by length, then ord. Members that nodes do not hold, and
    null contents, add nothing.
    """
    sizes = labels.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") >= least)
    members = labels.select("graph_id", "node_id", "label").join(sizes, ["graph_id", "label"])
    held = members.join(nodes.select("graph_id", "node_id", "ord", "content", "entities"), ["graph_id", "node_id"])
    counts = held.select("graph_id", "label", F.explode("entities").alias("entity")).groupBy("graph_id", "label", "entity").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("graph_id", "label").orderBy(F.desc("n"), "entity"))).where(F.col("k") <= names)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c])
    best = best.groupBy("graph_id", "label").agg(listed("entity").alias("entities"))
    said = held.where("content is not null").withColumn("k", F.row_number().over(Window.partitionBy("graph_id", "label").orderBy(F.length("content"), "ord", "node_id"))).where(F.col("k") <= shortest)
    said = said.groupBy("graph_id", "label").agg(F.substring(F.array_join(listed("content"), " | "), 1, 300).alias("said"))
    made = sizes.join(best, ["graph_id", "label"], "left").join(said, ["graph_id", "label"], "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    content = F.concat(F.lit("[Cluster: "), F.array_join(F.slice("entities", 1, 5), ", "), F.lit("] "), F.coalesce("said", F.lit("")))
    summaries = made.select("graph_id", new_edge_id(F.lit("cluster"), "graph_id", "label").alias("node_id"), "label", content.alias("content"), "entities", "n_members")
    edges = members.select("graph_id", new_edge_id(F.lit("cluster"), "graph_id", "label").alias("from_node"), F.col("node_id").alias("to_node"), F.lit("contains").alias("edge_type"), F.lit(0.7).alias("weight"))
    return summaries, edges
