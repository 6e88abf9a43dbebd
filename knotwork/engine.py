"""The engine: one object that builds, keeps, corrects and asks graphs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions import text as X
from knotwork.operators import ask as A
from knotwork.operators import corrections as C
from knotwork.operators import graph as G
from knotwork.operators import providers as M
from knotwork.operators import reflect as S
from knotwork.operators import render as N
from knotwork.operators import reports as H
from knotwork.operators import retrieve as R
from knotwork.operators import runs as U
from knotwork.session import materialise, ship
from knotwork.sources import files as L

NODE = (
    "graph_id string, node_id string, ord long, content string, content_hash string, node_type string, source struct<file:string,char_offset:long,line:int,section:string>, "
    "entities array<string>, metadata map<string,string>, node_level int, confidence double, created_at timestamp_ntz, last_accessed_at timestamp_ntz, access_count long, valid_until timestamp_ntz"
)


@dataclass
class Graph:
    """The tables of one or many graphs, told apart by graph_id."""

    nodes: DataFrame
    directed: DataFrame
    undirected: DataFrame


def nodes_of(sections: DataFrame, titles: DataFrame, as_of: str, least_chars: int = 20) -> DataFrame:
    """Nodes of parsed files: a document node for each file, a section node for each section, and its chunks of least_chars and more.

    sections (graph_id, file, sec_no, depth, title, content), titles (graph_id,
    file, title, metadata). The file's metadata go to all its nodes, with the
    title, the section's depth or the section's title. ord numbers the nodes of a
    file from its document on; ids are made of the graph, the file, the place in
    it and the content.
    """
    sections = sections.join(titles.select("graph_id", "file", "metadata"), ["graph_id", "file"], "left")
    at = lambda pos: [F.col("graph_id"), F.col("file"), F.col("sec_no").cast("int").alias("sec_no"), pos]
    more = lambda k, v: F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda x, _: x != k), F.create_map(F.lit(k), v)).alias("metadata")
    first = F.lit(0).alias("pos")
    files = titles.withColumn("sec_no", F.lit(-1)).select(*at(first), F.col("title").alias("content"), F.lit("document").alias("node_type"), F.lit(None).cast("string").alias("section"), more("title", F.col("title")))
    heads = sections.select(*at(first), F.col("title").alias("content"), F.lit("section").alias("node_type"), F.col("title").alias("section"), more("depth", F.col("depth").cast("string")))
    each = sections.select("graph_id", "file", "sec_no", "title", "metadata", F.posexplode(X.chunks(F.col("content"))).alias("_p", "content")).where(F.length("content") >= least_chars)
    pieces = each.select(*at((F.col("_p") + 1).alias("pos")), "content", X.chunk_type(F.col("content")).alias("node_type"), F.col("title").alias("section"), more("sectionTitle", F.col("title")))
    rows = files.unionByName(heads).unionByName(pieces)
    place = Window.partitionBy("graph_id", "file").orderBy("sec_no", "pos")
    now = C.stamped(as_of)
    none = F.lit(None)
    return rows.withColumns({"ord": F.row_number().over(place).cast("long"), "content_hash": X.content_hash(F.col("content"))}).select(
        "graph_id", G.new_edge_id("graph_id", "file", F.col("sec_no").cast("string"), F.col("pos").cast("string"), "content_hash").alias("node_id"), "ord", "content", "content_hash", "node_type",
        F.struct(F.col("file"), F.lit(0).cast("long").alias("char_offset"), none.cast("int").alias("line"), F.col("section")).alias("source"),
        X.entities(F.col("content")).alias("entities"), "metadata", F.lit(0).alias("node_level"), F.lit(0.9).alias("confidence"),
        now.alias("created_at"), now.alias("last_accessed_at"), F.lit(0).cast("long").alias("access_count"), none.cast("timestamp_ntz").alias("valid_until"),
    )


def edges_of(nodes: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The directed and undirected edges that nodes give."""
    now = C.stamped(as_of).alias("created_at")
    one = G.contains_edges(nodes).unionByName(G.precedes_edges(nodes)).unionByName(G.cites_edges(nodes)).unionByName(G.defines_edges(nodes))
    directed = one.select("graph_id", G.new_edge_id("graph_id", "from_node", "to_node", "edge_type").alias("edge_id"), "from_node", "to_node", "edge_type", "weight", now).dropDuplicates(["edge_id"])
    alike = materialise(G.similarity_edges(nodes), "alike")
    near = G.cooccurrence_edges(nodes)
    seen = alike.select("graph_id", F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"))
    two = alike.unionByName(near.join(seen, ["graph_id", "node_a", "node_b"], "left_anti"))
    undirected = two.select("graph_id", G.new_edge_id("graph_id", "node_a", "node_b", "edge_type").alias("edge_id"), "node_a", "node_b", "edge_type", "weight", now).dropDuplicates(["edge_id"])
    return directed, undirected


class Engine:
    """Builds graphs and answers over them; every method returns DataFrames or bounded text."""

    def __init__(self, spark: SparkSession, as_of: str) -> None:
        self.spark, self.as_of = ship(spark), as_of

    def ingest(self, path: str, graph_id: str, least_nodes: int = 50, readers: dict[str, Callable[[bytes], str]] | None = None) -> tuple[Graph, DataFrame]:
        """(graph, skipped): the graph of the files under a path; weak edges and orphans leave graphs of more than least_nodes.

        readers makes text of files that hold none, by their ending: {"pdf": ...}.
        """
        sections, titles, skipped = L.parse_files(L.read_texts(self.spark, path, readers))
        mark = lambda df: df.withColumn("graph_id", F.lit(graph_id))
        nodes = materialise(nodes_of(mark(sections), mark(titles), self.as_of), "nodes")
        directed, undirected = (materialise(e, "edges") for e in edges_of(nodes, self.as_of))
        if nodes.count() > least_nodes:
            directed, undirected = G.strong_edges(directed, 0.05), G.strong_edges(undirected, 0.1)
            nodes = G.pruned_nodes(nodes, directed, undirected, 0.05, 0.1)
        return Graph(nodes, directed, undirected), skipped

    def load(self, path: str, graph_id: str | None = None) -> Graph:
        return Graph(*(L.load_graph(self.spark, path, n, graph_id) for n in ("nodes", "directed_edges", "undirected_edges")))

    def save(self, graph: Graph, path: str) -> None:
        L.save_graph({"nodes": graph.nodes, "directed_edges": graph.directed, "undirected_edges": graph.undirected}, path)

    def update(self, graph: Graph, nodes: DataFrame) -> Graph:
        """The graph with new nodes whose content their graph does not hold, and the edges among them."""
        new = materialise(G.unseen(nodes.select(*graph.nodes.columns), graph.nodes, "content", ("graph_id",)), "new")
        directed, undirected = edges_of(new, self.as_of)
        return Graph(graph.nodes.unionByName(new), graph.directed.unionByName(directed, True), graph.undirected.unionByName(undirected, True))

    def index(self, graph: Graph) -> tuple[DataFrame, DataFrame]:
        """The term index of a graph, to be kept for many questions."""
        return A.term_index(graph.nodes)

    def query(
        self, graph: Graph, questions: DataFrame, key: str = "q", text: str = "question", options: A.Asking = A.Asking(), index: tuple[DataFrame, DataFrame] | None = None,
        model: Callable[[], M.VectorModel] = M.HashedWords,
    ) -> DataFrame:
        """(key, graph_id, node_id, score, place): the best nodes for every question; in the modes vectors and hybrid by the vectors of a model too."""
        synonyms = R.synonym_map(graph.nodes, graph.undirected)
        likeness = None
        if options.mode != "terms":
            content = G.content_only(graph.nodes).withColumn("_id", F.to_json(F.struct(*A.NODE)))
            told = M.embedded(content, "_id", "content", model).select(F.from_json("_id", "graph_id string, node_id string").alias("i"), "embedding").select("i.*", "embedding")
            likeness = R.likeness(told, "embedding", M.embedded(questions, key, text, model).toDF("q", "query")).withColumnRenamed("q", key)
            likeness = materialise(likeness.withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= options.least_cosine), "likeness")
        return A.ask(graph.nodes, graph.directed, graph.undirected, questions, self.as_of, key, text, options, index, synonyms, likeness)

    def texts(self, graph: Graph, questions: DataFrame, key: str = "q", text: str = "question", options: A.Asking = A.Asking()) -> DataFrame:
        """(key, text): the subgraph for every question as text, for any number of questions."""
        best = materialise(self.query(graph, questions, key, text, options), "best")
        one = materialise(R.edges_between(best, graph.directed.select("graph_id", "from_node", "to_node", "edge_type", "weight"), key, ("from_node", "to_node")), "one")
        two = materialise(R.edges_between(best, graph.undirected.select("graph_id", "node_a", "node_b", "edge_type", "weight"), key, ("node_a", "node_b")), "two")
        return N.subgraph_texts(best, graph.nodes, one, two, key)

    def answer(self, graph: Graph, questions: DataFrame, model: Callable[[], M.TextModel] = M.FirstSentences, key: str = "q", text: str = "question") -> DataFrame:
        """(key, answer): a model's answer to every question from its subgraph."""
        asked = questions.select(key, F.col(text).alias("asked")).join(self.texts(graph, questions, key, text), key)
        prompts = asked.select(key, F.concat(F.lit("Answer from this subgraph alone.\n\n"), "text", F.lit("\n\nQuestion: "), "asked").alias("prompt"))
        return M.answered(prompts, key, "prompt", model)

    def context(self, graph: Graph, question: str, options: A.Asking = A.Asking()) -> str:
        """The subgraph for one question as text; empty if it has no seeds."""
        rows = self.texts(graph, self.spark.createDataFrame([("q", question)], "q string, question string"), options=options).collect()
        return rows[0]["text"] if rows else ""

    def summarised(self, graph: Graph, model: Callable[[], M.TextModel] = M.FirstSentences) -> Graph:
        """The graph with a summary node for every session of messages and its summarizes edges."""
        nodes, edges = M.session_nodes(graph.nodes, self.as_of, model)
        return Graph(graph.nodes.unionByName(nodes.select(*graph.nodes.columns)), graph.directed.unionByName(edges, True), graph.undirected)

    def evaluate(self, graph: Graph, items: DataFrame, path: str, model: Callable[[], M.TextModel] = M.FirstSentences, judge: Callable[[], M.TextModel] = M.FirstSentences) -> DataFrame:
        """All results for items (question_id, question_type, question, answer): those under path, and those of the questions that have none yet, which are added there."""
        todo = materialise(U.to_do(items, U.done_questions(self.spark, path)), "todo")
        best = materialise(self.query(graph, todo, "question_id"), "best")
        sizes = best.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_nodes"))
        answers = self.answer(graph, todo, model, "question_id").withColumnRenamed("answer", "predicted")
        U.append_results(U.graded(todo, answers, sizes, U.type_distribution(best, graph.nodes, "question_id"), judge), path)
        newest = U.done_questions(self.spark, path).groupBy("question_id").agg(F.max_by(F.struct("*"), F.when(F.col("error").isNull(), 1).otherwise(0)).alias("r"))
        return newest.select("r.*")

    def benchmark(self, graph: Graph, questions: DataFrame, key: str = "q", text: str = "question") -> DataFrame:
        """(n_questions, mean_ms, mean_nodes, mean_tokens) of asking all questions at once."""
        began = time.time()
        best = materialise(self.query(graph, questions, key, text), "best")
        texts = materialise(self.texts(graph, questions, key, text), "texts")
        return U.cost_summary(texts, best.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes")), time.time() - began)

    def correct(self, graph: Graph, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(changed nodes, added nodes, added edges) for change rows."""
        added = C.added_nodes(graph.nodes, changes)
        return C.corrected_nodes(graph.nodes, changes, self.as_of), added, C.correction_edges(added)

    def forget(self, graph: Graph, topic: str | None = None, before: str | None = None) -> DataFrame:
        if topic is not None:
            return C.forgotten_by_topic(graph.nodes, topic, self.as_of)
        if before is None:
            raise ValueError("name a topic or a time")
        return C.forgotten_by_time(graph.nodes, before, self.as_of)

    def reflect(self, graph: Graph) -> dict[str, DataFrame]:
        """New rows only; the graph stays as it is."""
        return {
            "contradictions": S.contradictions(graph.nodes), "discoveries": S.discoveries(graph.nodes, graph.undirected),
            "decay": S.confidence_decay(graph.nodes, self.as_of), "inferred": S.inferred_edges(graph.directed),
        }

    def audit(self, graph: Graph) -> dict[str, DataFrame]:
        found = self.reflect(graph)
        return {
            "entities": H.entity_reports(graph.nodes), "health": H.graph_health(graph.nodes, graph.directed, graph.undirected, self.as_of),
            "gaps": H.coverage_gaps(graph.nodes), "contradictions": found["contradictions"], "discoveries": found["discoveries"],
        }

    def topic_page(self, graph: Graph, topic: str) -> DataFrame:
        return H.topic_page(graph.nodes, topic)

    def stats(self, graph: Graph) -> DataFrame:
        return H.graph_stats(graph.nodes, graph.directed, graph.undirected)
