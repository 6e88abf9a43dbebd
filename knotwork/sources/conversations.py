"""Parsers of chat exports: one row for each message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import day_tag, paragraphs, stripped

ITEM = "array<struct<role:string,text:string>>"
EXPORT = "struct<title:string,mapping:map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>>>"
CHANNEL = "array<struct<type:string,text:string,bot_id:string,ts:string>>"


def chat_format(text: Column) -> Column:
    """chatgpt, slack, claude or raw, by what the text holds."""
    has = lambda s: F.contains(text, F.lit(s))
    return (
        F.when(has('"mapping"') & has('"message"'), "chatgpt").when(has('"type": "message"') & has('"channel"'), "slack")
        .when(has("Human:") | has("Assistant:") | has("> "), "claude").when(text.isNotNull(), "raw")
    )


def item(role: Column | str, text: Column) -> Column:
    return F.struct((role if isinstance(role, Column) else F.lit(role)).alias("role"), text.alias("text"))


def transcript_messages(text: Column) -> Column:
    """A transcript with speaker marks; blocks without a mark belong to nobody and are left out."""
    blocks = F.transform(F.split(text, r"(?i)\n\n(?=(?:Human|Assistant|User|System):)"), stripped)
    mark = r"(?i)^(human|user|assistant|system):\s*"
    who = lambda b: F.lower(F.regexp_extract(b, mark, 1))
    role = lambda b: F.when(who(b) == "human", "user").otherwise(who(b))
    return F.transform(F.filter(blocks, lambda b: b.rlike(mark)), lambda b: item(role(b), stripped(F.regexp_replace(b, mark, ""))))


def export_messages(text: Column) -> Column:
    """The first conversation of an export with a mapping, user and assistant only; null if it cannot be read."""
    first = F.coalesce(F.from_json(text, f"array<{EXPORT}>")[0], F.from_json(text, EXPORT))
    nodes = F.map_values(first["mapping"])
    told = F.filter(nodes, lambda n: n["message"]["content"]["parts"].isNotNull() & n["message"]["author"]["role"].isin("user", "assistant"))
    said = F.transform(told, lambda n: item(n["message"]["author"]["role"], stripped(F.array_join(n["message"]["content"]["parts"], "\n"))))
    return F.filter(said, lambda m: m["text"] != "")


def channel_messages(text: Column) -> Column:
    """The messages of a channel export; those of bots are the assistant's. null if it cannot be read."""
    whole = F.from_json(text, f"struct<messages:{CHANNEL}>")["messages"]
    rows = F.when(F.ltrim(text).startswith("["), F.from_json(text, CHANNEL)).otherwise(whole)
    kept = F.filter(rows, lambda m: (m["type"] == "message") & (F.coalesce(m["text"], F.lit("")) != ""))
    return F.transform(kept, lambda m: item(F.when(m["bot_id"].isNotNull(), "assistant").otherwise("user"), m["text"]))


def raw_messages(text: Column) -> Column:
    """Paragraphs, the user's and the assistant's in turn."""
    return F.transform(paragraphs(text), lambda p, i: item(F.when(i % 2 == 0, "user").otherwise("assistant"), stripped(p)))


def parse_chats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, format, pos, role, text): the messages of chat texts in any of the formats; what cannot be read counts as raw."""
    column, kind = F.col(text), chat_format(F.col(text))
    made = F.when(kind == "claude", transcript_messages(column)).when(kind == "chatgpt", export_messages(column)).when(kind == "slack", channel_messages(column))
    items = F.coalesce(made.cast(ITEM), raw_messages(column).cast(ITEM))
    return df.select(key, kind.alias("format"), F.posexplode(items).alias("pos", "m")).select(key, "format", "pos", "m.role", "m.text")


def chat_titles(messages: DataFrame, key: str) -> DataFrame:
    """(key, title): the first user message, 80 characters of it at most."""
    first = messages.where("role = 'user'").groupBy(key).agg(F.min_by("text", "pos").alias("t"))
    rows = messages.select(key).distinct().join(first, key, "left")
    cut = F.when(F.length("t") > 80, F.concat(F.left("t", F.lit(80)), F.lit("..."))).otherwise(F.col("t"))
    return rows.select(key, F.coalesce(cut, F.lit("Untitled Conversation")).alias("title"))


def turn_sections(messages: DataFrame, key: str) -> DataFrame:
    """(key, sec_no, title, content): messages without the system's, titled by speaker and turn; a turn is two messages."""
    place = Window.partitionBy(key).orderBy("pos")
    rows = messages.where("role <> 'system'").withColumn("i", F.row_number().over(place) - 1)
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    title = F.concat(who, F.lit(" (turn "), (F.floor(F.col("i") / 2) + 1).cast("string"), F.lit(")"))
    return rows.select(key, F.col("i").alias("sec_no"), title.alias("title"), F.col("text").alias("content"))


QUESTION = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)


def session_messages(questions: DataFrame) -> DataFrame:
    """(question_id, session_id, session_date, pos, role, text): the sessions of evaluation questions, with missing ids and dates filled in."""
    each = questions.select("question_id", "question_date", "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("s", "turns"))
    named = each.select(
        "question_id", F.coalesce(F.get("haystack_session_ids", "s"), F.concat(F.lit("session_"), F.col("s").cast("string"))).alias("session_id"),
        day_tag(F.coalesce(F.get("haystack_dates", "s"), F.col("question_date"))).alias("session_date"), F.posexplode("turns").alias("pos", "t"),
    )
    return named.select("question_id", "session_id", "session_date", "pos", "t.role", F.col("t.content").alias("text"))


def load_questions(spark, path: str, types: list[str] | None = None, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Evaluation questions from a JSON array: all, those of some types, or a sample that depends on the seed alone."""
    rows = spark.read.schema(QUESTION).json(path, multiLine=True)
    rows = rows.where(F.col("question_type").isin(types)) if types else rows
    return rows.orderBy(F.xxhash64("question_id", F.lit(seed)), "question_id").limit(limit) if limit else rows
