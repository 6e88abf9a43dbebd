"""Rebuilding conversations from single message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.operators.spread import rank_in_slices
from knotwork.session import materialise

#: Speaker words of the import formats, and what they stand for. Fixed values.
SPEAKERS = {
    "user": "user",
    "human": "user",
    "assistant": "assistant",
    "ai": "assistant",
    "bot": "assistant",
    "model": "assistant",
    "system": "system",
}
MARK = r"(?i)^[\s*_>#-]*(" + "|".join(SPEAKERS) + r")[\s*_]*:[\s*_]*"


def speaker_of(word: Column) -> Column:
    """user, assistant or system for a speaker word in any case; else null."""
    words = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    return words[F.lower(F.trim(word))]


def message_events(nodes: DataFrame) -> DataFrame:
    """One row per message row of nodes: the event's file, place, speaker, number and text marks.

    place orders the messages of a file: the character offset of a transcript,
    the sequence number of an export, the time stamp of a channel, or the turn
    with the user before the assistant. number is set where the import numbers
    its messages or turns. The text is kept as two 64-bit hashes, without its
    speaker mark and outer white space. Rows without a file are left out.
    """
    meta = lambda k: F.col("metadata")[k]
    file = F.col("source.file")
    kind = F.when(file.startswith("conversation:"), "transcript").when(file.startswith("slack:"), "channel").when(file.startswith("lme:"), "turns").otherwise("export")
    section = F.col("source.section")
    df = nodes.where((F.col("node_type") == "message") & file.isNotNull()).select(
        file.alias("file"), "node_id", "ord", kind.alias("kind"), "content", "created_at", "last_accessed_at", "access_count",
        F.nullif(F.regexp_extract("content", MARK, 1), F.lit("")).alias("mark"),
        F.nullif(F.regexp_extract(section, r"(?i)^\s*(user|assistant|system)\b", 1), F.lit("")).alias("heading"),
        F.coalesce(meta("turn").try_cast("long"), F.nullif(F.regexp_extract(section, r"(\d+)", 1), F.lit("")).try_cast("long")).alias("turn"),
        meta("seq").try_cast("long").alias("seq"),
        (meta("ts").try_cast("decimal(20,6)") * 1_000_000).cast("long").alias("ts"),
        F.col("source.char_offset").alias("at"), meta("role").alias("role"), meta("subtype").alias("subtype"),
        meta("bot_id").alias("bot_id"), meta("user").alias("account"), meta("deleted_at").isNotNull().alias("deleted"),
    )
    channel = F.when(F.col("subtype").isNotNull(), "system").when(F.col("bot_id").isNotNull(), "assistant").when(F.col("account").isNotNull(), "user")
    speaker = (
        F.when(F.col("kind") == "channel", channel)
        .when(F.col("kind") == "transcript", speaker_of(F.col("mark")))
        .when(F.col("kind") == "turns", speaker_of(F.coalesce("heading", "role")))
        .otherwise(speaker_of(F.col("role")))
    )
    text = F.coalesce(F.when(F.col("kind") == "transcript", F.regexp_replace("content", MARK, "")).otherwise(F.col("content")), F.lit(""))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    df = df.withColumns({"speaker": speaker, "text": text})
    place = (
        F.when(F.col("kind") == "channel", F.col("ts"))
        .when(F.col("kind") == "transcript", F.col("at"))
        .when(F.col("kind") == "turns", F.col("turn") * 2 + F.when(F.col("speaker") == "assistant", 1).otherwise(0))
        .otherwise(F.col("seq"))
    )
    return df.select(
        "file", "node_id", "ord", "speaker", place.alias("place"), "deleted",
        F.when(F.col("kind") == "turns", F.col("turn")).when(F.col("kind") == "export", F.col("seq")).alias("number"),
        F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"),
        F.col("text").rlike(r"[\p{L}\p{N}]").alias("says"),
        F.struct(F.coalesce("last_accessed_at", "created_at").alias("at"), F.coalesce("access_count", F.lit(0)).alias("seen")).alias("version"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """The last version of every node: redeliveries and edits fold into one row, deleted nodes leave.

    Redelivered rows bear a later version, so the latest one is the state of
    the node; a tie goes to the larger text hash and changes nothing where the
    texts agree.
    """
    rest = [c for c in events.columns if c not in ("node_id", "version")]
    last = events.groupBy("node_id").agg(F.max(F.struct("version", *sorted(rest, key=lambda c: c != "text_a"))).alias("e"))
    return last.select("node_id", *[F.col(f"e.{c}").alias(c) for c in rest]).where(~F.col("deleted"))


def rebuild_conversations(nodes: DataFrame, slice_rows: int = 50_000) -> DataFrame:
    """(file, place_no, speaker, node_id) of the messages of every whole conversation.

    The message rows are an event log. Versions of one node fold into its last
    state, then retries at one place of a file (same text, other node) fold into
    the node of the smallest ord. System rows only count for the numbering. A
    file is kept if every place holds one text with a letter or digit and a
    known speaker, no number between its first and last is missing, and
    user and assistant take turns from a user's to an assistant's message.

    Null contents are empty texts; a message whose place cannot be read breaks
    its file; rows without a file belong to no conversation; an empty table
    gives no rows. All per-file work is by grouping with partial aggregates;
    a file with a large share of all rows is ranked in slices of its places.
    """
    turns = materialise(fold_events(message_events(nodes)), "turns")
    spoken = turns.where(F.coalesce(F.col("speaker") != "system", F.lit(True)))
    first = F.min(F.struct("ord", "node_id", "speaker", "says")).alias("m")
    one_text = (F.min("text_a") == F.max("text_a")) & (F.min("text_b") == F.max("text_b"))
    places = spoken.groupBy("file", "place").agg(first, one_text.alias("one_text"))
    places = places.select(
        "file", "place", "m.node_id", "m.speaker",
        (F.col("one_text") & F.col("m.says") & F.col("m.speaker").isNotNull() & F.col("place").isNotNull()).alias("good"),
    )
    places = materialise(places, "places")
    ranked = rank_in_slices(places, "file", ["place"], slice_rows)

    odd = F.col("local_no") % 2 == 1
    user = F.coalesce(F.col("speaker") == "user", F.lit(False))
    slices = ranked.groupBy("file", "slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("good")).alias("broken"),
        F.count_if(user != odd).alias("wrong_even"),
        F.count_if(user == odd).alias("wrong_odd"),
    )
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.withColumn("before", before)
    wrong = F.when(F.col("before") % 2 == 0, F.col("wrong_even")).otherwise(F.col("wrong_odd"))
    whole = slices.groupBy("file").agg(F.sum("n").alias("n"), F.sum("broken").alias("broken"), F.sum(wrong).alias("wrong"))
    numbers = turns.where(F.col("number").isNotNull()).groupBy("file", "number").agg(F.lit(1).alias("one"))
    gaps = numbers.groupBy("file").agg((F.max("number") - F.min("number") + 1 - F.count(F.lit(1))).alias("gaps"))
    kept = (
        whole.join(gaps, "file", "left")
        .where((F.col("broken") == 0) & (F.col("wrong") == 0) & (F.col("n") % 2 == 0) & (F.coalesce("gaps", F.lit(0)) == 0))
        .select("file")
    )
    good = slices.join(kept, "file", "left_semi").select("file", "slice", "before")
    return ranked.join(good, ["file", "slice"]).select(
        "file", (F.col("before") + F.col("local_no")).cast("int").alias("place_no"), "speaker", "node_id"
    )
