"""Seams for models: embeddings and text, with offline stand-ins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import content_hash, entities
from knotwork.session import ship

#: What a model's answer about a node holds.
ENRICHMENT = "synthesis string, context string, sourceQuality string"


class TextModel(Protocol):
    """Answers prompts; made in every task."""

    def answer(self, prompts: list[str]) -> list[str]: ...


class VectorModel(Protocol):
    """Turns texts into vectors of one length; made in every task."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class FirstSentences:
    """The offline text model: the first sentences of the prompt's last part, as the JSON that is asked for."""

    def answer(self, prompts: list[str]) -> list[str]:
        import json

        out = []
        for p in prompts:
            parts = p.rsplit("\n\n", 1)[-1].split(". ")
            out.append(json.dumps({"synthesis": parts[0][:200], "context": ". ".join(parts[:2])[:400], "sourceQuality": "unknown"}))
        return out


class HashedWords:
    """The offline vector model: words hashed to 64 signed places, of length one."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(64)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % 64] += 1.0 if h & 64 else -1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out


def answered(df: DataFrame, key: str, prompt: str, model: Callable[[], TextModel], at_once: int = 32) -> DataFrame:
    """(key, answer): a model's answer to every prompt, in batches; a batch that fails has null answers."""
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = model()
        for batch in batches:
            for i in range(0, len(batch), at_once):
                part = batch.iloc[i : i + at_once]
                try:
                    said = made.answer(list(part["prompt"]))
                except Exception:
                    said = [None] * len(part)
                yield pd.DataFrame({"key": part["key"], "answer": said})

    ship(df.sparkSession)
    rows = df.where(F.col(prompt).isNotNull()).select(F.col(key).alias("key"), F.col(prompt).alias("prompt"))
    return rows.mapInPandas(work, f"key {kind}, answer string").withColumnRenamed("key", key)


def embedded(df: DataFrame, key: str, text: str, model: Callable[[], VectorModel] = HashedWords, at_once: int = 256) -> DataFrame:
    """(key, embedding): the vector of every text that is not blank."""
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = model()
        for batch in batches:
            for i in range(0, len(batch), at_once):
                part = batch.iloc[i : i + at_once]
                yield pd.DataFrame({"key": part["key"], "embedding": made.embed(list(part["text"]))})

    ship(df.sparkSession)
    rows = df.where(F.trim(F.col(text)) != "").select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(work, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def with_cache(df: DataFrame, key: str, prompt: str, cache: DataFrame, task: str, version: int, model: Callable[[], TextModel]) -> tuple[DataFrame, DataFrame]:
    """(answers, additions): answers (key, answer) from a cache (task, version, hash, answer) where it has them, else from the model.

    Prompts with equal text are asked once; additions are the rows to append to
    the cache.
    """
    asked = df.where(F.col(prompt).isNotNull()).select(key, F.col(prompt).alias("prompt"), content_hash(F.col(prompt)).alias("hash"))
    known = cache.where((F.col("task") == task) & (F.col("version") == version)).groupBy("hash").agg(F.max("answer").alias("answer"))
    new = asked.join(known, "hash", "left_anti").groupBy("hash").agg(F.first("prompt").alias("prompt"))
    fresh = answered(new, "hash", "prompt", model).where("answer is not null")
    answers = asked.join(known.unionByName(fresh), "hash").select(key, "answer")
    return answers, fresh.select(F.lit(task).alias("task"), F.lit(version).alias("version"), "hash", "answer")


def json_in(answer: Column, schema: str) -> Column:
    """The outermost JSON object in an answer; null if there is none."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)


def enrichment_prompt(content: Column, node_type: Column, names: Column, around: Column) -> Column:
    """What to ask a model about a node."""
    return F.concat(
        F.lit("Say in one sentence why this piece of a knowledge graph matters (synthesis), in two how it relates to its neighbours (context), and whether it is a "
              "primary, secondary, inference or unknown source (sourceQuality). Answer as one JSON object.\n\nType: "),
        F.coalesce(node_type, F.lit("fact")), F.lit("\nNames: "), F.coalesce(F.array_join(names, ", "), F.lit("none")), F.lit("\nNeighbours:\n"),
        F.coalesce(F.array_join(around, "\n"), F.lit("none")), F.lit("\n\n"), content,
    )


def enriched(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """(graph_id, node_id, synthesis, context, source_quality, confidence): what answers add to nodes; confidence grows by 0.05, to 0.98 at most.

    Answers that hold no synthesis or context change nothing.
    """
    read = answers.select("node_id", json_in(F.col("answer"), ENRICHMENT).alias("j")).where("j.synthesis <> '' and j.context <> ''")
    both = nodes.join(read, "node_id")
    confidence = F.greatest(F.col("confidence"), F.least(F.col("confidence") + 0.05, F.lit(0.98)))
    return both.select("graph_id", "node_id", "j.synthesis", "j.context", F.coalesce("j.sourceQuality", F.lit("unknown")).alias("source_quality"), confidence.alias("confidence"))


def session_prompts(messages: DataFrame, session: list[str], text: str, order: str, most_chars: int = 12_000) -> DataFrame:
    """(session, part_no, prompt): the prompts for each session, which hold all its messages in order; longer sessions have several parts.

    No prompt holds more than most_chars of a session, so that a session of any
    length gives bounded groups. Messages stay whole unless they are longer than
    half of that.
    """
    half = most_chars // 2
    told = messages.where(F.col(text).isNotNull()).select(*session, order, text).distinct()
    sizes = told.groupBy(*session).agg((F.sum(F.length(text) + 1) - 1).alias("_chars"))
    cuts = F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(half)), lambda i: F.substring(F.col(text), i + 1, F.lit(half))))
    pieces = told.select(*session, order, F.xxhash64(text).alias("_hash"), cuts.alias("_piece", "_text"))
    place = Window.partitionBy(*session).orderBy(order, "_hash", "_piece")
    pieces = pieces.withColumn("_end", F.sum(F.length("_text") + 1).over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(place))
    same = [F.col(f"_p.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in session]
    placed = pieces.alias("_p").join(sizes.alias("_s"), reduce(lambda a, b: a & b, same)).select("_p.*", "_chars")
    start = F.col("_end") - F.length("_text") - 1
    part = F.when(F.col("_chars") <= most_chars, F.lit(0)).otherwise(F.floor(start / half)).cast("int")
    rows = placed.groupBy(*session, part.alias("part_no")).agg(F.array_sort(F.collect_list(F.struct("_n", "_piece", "_text"))).alias("m"))
    joined = F.aggregate("m", F.lit(""), lambda s, x: F.concat(s, F.when((s == "") | (x["_piece"] > 0), "").otherwise("\n"), x["_text"]))
    return rows.select(*session, "part_no", F.concat(F.lit("Sum up this conversation and list its countable claims as one JSON object.\n\n"), joined).alias("prompt"))


def session_answers(parts: DataFrame, session: list[str], part: str, answer: str) -> DataFrame:
    """(session, answer): the answers to a session's parts, joined in order; null if one of them is missing, so that no part passes for the whole."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part, answer))), lambda x: x[answer]), " ")
    return parts.groupBy(*session).agg(F.when(F.count(answer) == F.count(F.lit(1)), whole).alias(answer))


def session_nodes(nodes: DataFrame, as_of: str, model: Callable[[], TextModel]) -> tuple[DataFrame, DataFrame]:
    """(summaries, edges): a session-summary node for every file of messages that the model sums up, and its summarizes edges of weight 0.7.

    Summaries have the columns of nodes: level 1, confidence 0.8, the date and
    number of turns of their session. A session of which a part gets no answer
    has no summary, and the nodes stay as they are.
    """
    said = nodes.where("node_type = 'message' and source.file is not null").select("graph_id", "node_id", F.col("source.file").alias("file"), "ord", "content", F.col("metadata")["session_date"].alias("session_date"))
    prompts = session_prompts(said, ["graph_id", "file"], "content", "ord")
    prompts = prompts.withColumn("k", F.to_json(F.struct("graph_id", "file", "part_no")))
    told = answered(prompts, "k", "prompt", model).select(F.from_json("k", "graph_id string, file string, part_no int").alias("k"), json_in(F.col("answer"), ENRICHMENT)["synthesis"].alias("summary"))
    whole = session_answers(told.select("k.*", "summary"), ["graph_id", "file"], "part_no", "summary").where("summary is not null")
    turns = said.groupBy("graph_id", "file").agg(F.count(F.lit(1)).alias("turns"), F.max("session_date").alias("session_date"))
    now, none = F.lit(as_of).cast("timestamp_ntz"), F.lit(None)
    key = F.substring(F.sha2(F.concat_ws("|", F.lit("session-summary"), "graph_id", "file"), 256), 1, 16)
    meta = F.map_filter(F.create_map(F.lit("session_id"), F.col("file"), F.lit("session_date"), F.col("session_date"), F.lit("turn_count"), F.col("turns").cast("string")), lambda _, v: v.isNotNull())
    made = whole.join(turns, ["graph_id", "file"]).select(
        "graph_id", key.alias("node_id"), F.lit(0).cast("long").alias("ord"), F.col("summary").alias("content"), content_hash(F.col("summary")).alias("content_hash"), F.lit("session-summary").alias("node_type"),
        F.struct(F.col("file"), F.lit(0).cast("long").alias("char_offset"), none.cast("int").alias("line"), F.lit("session-summary").alias("section")).alias("source"),
        entities(F.col("summary")).alias("entities"), meta.alias("metadata"), F.lit(1).alias("node_level"), F.lit(0.8).alias("confidence"), now.alias("created_at"), now.alias("last_accessed_at"),
        F.lit(0).cast("long").alias("access_count"), none.cast("timestamp_ntz").alias("valid_until"),
    )
    held = whole.select("graph_id", "file", key.alias("from_node"))
    edges = said.join(held, ["graph_id", "file"]).select(
        "graph_id", F.substring(F.sha2(F.concat_ws("|", "from_node", "node_id", F.lit("summarizes")), 256), 1, 16).alias("edge_id"), "from_node", F.col("node_id").alias("to_node"),
        F.lit("summarizes").alias("edge_type"), F.lit(0.7).alias("weight"), now.alias("created_at"),
    )
    return made, edges
