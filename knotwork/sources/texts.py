"""Parsers that turn whole texts into section rows, as column work without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.functions.text import stripped

HEADING = r"^(#{1,6})[^\S\n]+([^\n]+)"
#: Lines that begin a section of a paper. Fixed values.
PAPER_PARTS = "abstract|introduction|conclusion|references|related work|methodology|results|discussion|acknowledgments"


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sec_no, parent_no, depth, title, content): the headings of markdown texts with the lines below them.

    sec_no counts from 1; parent_no is the nearest heading before that is less
    deep. Text before the first heading is section 0, titled Content, so that a
    text without headings is kept; it is left out if blank. Null texts give no
    rows; a # line inside a code fence counts as a heading.
    """
    cut = F.split(F.col(text), r"(?<![^\n])(?=#{1,6}[^\S\n]+[^\n])")
    parts = df.select(key, F.col(text).rlike(r"\A#{1,6}[^\S\n]+[^\n]").alias("at_once"), F.posexplode(cut).alias("n", "part"))
    parts = parts.withColumn("sec_no", F.col("n") + F.when(F.col("at_once"), 1).otherwise(0))
    head = F.col("sec_no") > 0
    rows = parts.select(
        key, "sec_no",
        F.when(head, F.length(F.regexp_extract("part", HEADING, 1))).otherwise(1).alias("depth"),
        F.when(head, stripped(F.regexp_extract("part", HEADING, 2))).otherwise("Content").alias("title"),
        stripped(F.when(head, F.regexp_replace("part", r"\A[^\n]*\n?", "")).otherwise(F.col("part"))).alias("content"),
    ).where(head | (F.col("content") != ""))
    before = Window.partitionBy(key).orderBy("sec_no").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("depth") > d, F.max(F.when((F.col("depth") == d) & (F.col("sec_no") > 0), F.col("sec_no"))).over(before)) for d in range(1, 6)]
    return rows.select(key, "sec_no", F.greatest(*above).alias("parent_no"), "depth", "title", "content")


def markdown_title(text: Column) -> Column:
    """The first heading of depth one, or Untitled."""
    return F.coalesce(F.nullif(stripped(F.regexp_extract(text, r"(?<![^\n])#[^\S\n]+([^\n]+)", 1)), F.lit("")), F.lit("Untitled"))


def front_matter(text: Column) -> Column:
    """The key: value lines between two --- at the very beginning, as a map; empty if there are none."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    pattern = r"(?m)^([A-Za-z0-9_]+):[^\S\n]*([^\n]+)$"
    keys, values = (F.regexp_extract_all(block, F.lit(pattern), F.lit(i)) for i in (1, 2))
    last = F.filter(F.sequence(F.lit(1), F.size(keys)), lambda i: ~F.array_contains(F.slice(keys, i + 1, F.size(keys)), F.element_at(keys, i)))
    pick = lambda a: F.transform(last, lambda i: F.trim(F.element_at(a, i)))
    return F.when(F.size(keys) > 0, F.map_from_arrays(pick(keys), pick(values))).otherwise(F.create_map().cast("map<string,string>"))


def subtitle_blocks(text: Column) -> Column:
    """The spoken blocks of subtitles: without numbers, times and the header, each block's lines joined by blanks."""
    blocks = F.split(F.replace(text, F.lit("\r"), F.lit("")), r"\n[^\S\n]*(?=\n)")
    kept = lambda line: (line != "") & ~line.rlike(r"^[0-9]+$") & ~F.contains(line, F.lit("-->")) & (line != "WEBVTT")
    joined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), stripped), kept), " "))
    return F.filter(joined, lambda b: b != "")


def grouped_sections(items: Column, size: int, glue: str, name: str) -> Column:
    """An array of texts as an array of (title, content) with `size` texts each, titled `name` first-last."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0)))
    section = lambda i: F.struct(
        F.concat(F.lit(f"{name} "), (i * size + 1).cast("string"), F.lit("-"), F.least((i + 1) * size, F.size(items)).cast("string")).alias("title"),
        F.array_join(F.slice(items, i * size + 1, size), glue).alias("content"),
    )
    return F.when(F.size(items) > 0, F.transform(starts, section)).otherwise(F.array().cast("array<struct<title:string,content:string>>"))


def subtitle_sections(text: Column) -> Column:
    """Subtitles as sections of ten blocks."""
    return grouped_sections(subtitle_blocks(text), 10, " ", "Transcript")


def paper_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sec_no, title, content): the text of a paper cut at lines that look like headers.

    Headers are short capitalised lines without a full stop, numbered ones, and
    the usual parts. Text before the first header and headers without text are
    left out; without any header all text is one section, Content.
    """
    lines = df.select(key, F.posexplode(F.transform(F.split(F.col(text), "\n"), stripped)).alias("pos", "line")).where("line <> ''")
    short = (F.length("line") < 80) & F.col("line").rlike("^[A-Z]") & ~F.col("line").endswith(".")
    header = (short | F.col("line").rlike(r"^[0-9]+\.?\s+[A-Z]") | F.col("line").rlike(f"(?i)^({PAPER_PARTS})")) & (F.length("line") > 2)
    lines = lines.withColumn("header", header)
    lines = lines.withColumn("sec_no", F.sum(F.col("header").cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("pos", "line")))), lambda x: x["line"])
    rows = lines.groupBy(key, "sec_no").agg(F.max(F.when(F.col("header"), F.col("line"))).alias("title"), F.array_join(body, "\n").alias("content"))
    most = F.max("sec_no").over(Window.partitionBy(key))
    rows = rows.withColumn("most", most).where((F.col("content") != "") & ((F.col("sec_no") > 0) | (F.col("most") == 0)))
    return rows.select(key, "sec_no", F.coalesce("title", F.lit("Content")).alias("title"), "content")


def table_sections(rows: DataFrame, file: str, line_no: str, columns: list[str], size: int = 10) -> DataFrame:
    """(file, sec_no, title, content): table rows as text, `size` rows a section, and first a section on the schema.

    line_no counts the rows of a file from 0 without gaps, so that no file has
    to be numbered in one task; a null value reads N/A.
    """
    shown = F.array_join(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for c in columns]), ", ")
    each = rows.select(file, F.col(line_no).alias("i"), shown.alias("row"), F.floor(F.col(line_no) / size).alias("batch"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"])
    batches = each.groupBy(file, "batch").agg(F.array_join(texts, "\n").alias("content"), F.min("i").alias("a"), F.max("i").alias("b"))
    title = F.concat(F.lit("Rows "), (F.col("a") + 1).cast("string"), F.lit("-"), (F.col("b") + 1).cast("string"))
    schema = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    about = F.concat(F.lit("This dataset has "), F.col("n").cast("string"), F.lit(f" rows and {len(columns)} columns: {', '.join(columns)}."))
    first = schema.select(file, F.lit(0).cast("long").alias("sec_no"), F.lit("Schema").alias("title"), about.alias("content"))
    return first.unionByName(batches.select(file, (F.col("batch") + 1).alias("sec_no"), title.alias("title"), "content"))


def json_sections(text: Column) -> Column:
    """A JSON array as sections of ten items, a JSON object as one section for each key; null if the text is neither."""
    items = F.from_json(text, "array<string>")
    fields = F.from_json(text, "map<string,string>")
    as_map = lambda x: F.from_json(x, "map<string,string>")
    pairs = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))), ", ")
    shown = F.transform(items, lambda x: F.when(x.startswith("{"), pairs(as_map(x))).otherwise(F.coalesce(x, F.lit("null"))))
    first = F.array(F.struct(F.lit("Overview").alias("title"), F.concat(F.lit("Array of "), F.size(items).cast("string"), F.lit(" items.")).alias("content")))
    cut = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("title"), F.left(F.coalesce(e["value"], F.lit("null")), F.lit(1000)).alias("content")))
    start = F.ltrim(text)
    return F.when(start.startswith("["), F.concat(first, grouped_sections(shown, 10, "\n", "Items"))).when(start.startswith("{"), cut)
