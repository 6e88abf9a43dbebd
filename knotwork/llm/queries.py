"""The queries of this subpackage, each a callable of (session, data folder), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.conversations import rebuild_conversations
from knotwork.llm.leakage import leaked_items
from knotwork.llm.names import link_names, spelling_pairs
from knotwork.llm.nearcopies import near_copy_groups, near_copy_pairs
from knotwork.llm.oracles import SQL
from knotwork.llm.packing import pack_documents
from knotwork.llm.reading import fit_reading, reading_levels, word_difficulties
from knotwork.llm.splitting import split_texts
from knotwork.session import table

#: Node types that are not text pieces of source files. Fixed values.
NOT_PIECES = ["document", "section", "message"]


def long_node_pieces(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nodes").select("node_id", "content", F.col("source.section").alias("section"))
    return split_texts(nodes, 1200, 120)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return rebuild_conversations(table(spark, sf, "nodes"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return long_node_pieces(spark, sf).where("piece_no = 1").select("node_id", "forced")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return long_node_pieces(spark, sf)


def p2_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """The content that the pieces of every long node give again, and whether they keep to the limit, the overlap and the order."""
    pieces = F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece")))
    rows = long_node_pieces(spark, sf).groupBy("node_id").agg(pieces.alias("p"))
    later = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    shared = F.forall(F.zip_with(F.slice("p", 1, F.size("p") - 1), later, lambda a, b: (F.right(a["piece"], F.lit(120)) == F.left(b["piece"], F.lit(120))) & (b["start"] == a["end"] - 120)), lambda x: x)
    rebuilt = F.concat(F.element_at("p", 1)["piece"], F.array_join(F.transform(later, lambda x: F.substring(x["piece"], F.lit(121), F.length(x["piece"]))), ""))
    fits = F.forall("p", lambda x: F.length(x["piece"]) <= 1200)
    return rows.select("node_id", F.md5(rebuilt).alias("content_md5"), F.length(rebuilt).alias("n_chars"), fits.alias("all_fit"), shared.alias("all_overlap"))


def written_names(spark: SparkSession, sf: str) -> DataFrame:
    reports = table(spark, sf, "entity_reports")
    listed = table(spark, sf, "nodes").select(F.explode("entities").alias("name")).unionAll(reports.select(F.explode("related_persons")))
    return listed.unionAll(reports.select("name"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_pairs(link_names(written_names(spark, sf)))


def p4_entities(spark: SparkSession, sf: str) -> DataFrame:
    return link_names(written_names(spark, sf))


def text_pieces(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nodes")
    return nodes.where(F.col("node_type").isNull() | ~F.col("node_type").isin(NOT_PIECES))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_copy_pairs(text_pieces(spark, sf), threshold=0.5, shingle=3, min_words=20)


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_copy_groups(text_pieces(spark, sf), threshold=0.5, shingle=3, min_words=20)


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), 2048)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"), width=12)


def english_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.where(F.lower("lang").startswith("en") & (F.col("doc_format").isNull() | (F.col("doc_format") != "table")))


def english_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_levels(english_documents(spark, sf), table(spark, sf, "reading_labels"))


def p8_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = english_documents(spark, sf)
    found = word_difficulties(docs, fit_reading(docs, table(spark, sf, "reading_labels")))
    return found.select("word", "n_sentences", F.round("difficulty", 1).alias("difficulty"), F.round("discrimination", 2).alias("discrimination"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return english_levels(spark, sf).select("doc_id", "band")


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    levels = english_levels(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return levels.groupBy("source", "band").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("level"), 1).alias("mean_level"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_pieces, p2_rebuilt, p4_found, p4_entities, p5_found, p5_groups, p6_containers, p7_found, p8_found, p8_profile, p8_words)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
