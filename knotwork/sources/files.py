"""Reading files of several kinds, and the graph's own store."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import materialise, ship
from knotwork.sources.texts import front_matter, json_sections, markdown_sections, markdown_title, paper_sections, subtitle_sections

#: What pages hold besides their text. Fixed values.
DROPPED = {"script", "style", "nav", "footer", "header", "aside"}
DROPPED_CLASSES = {"sidebar", "nav"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
READ_AS = {"md": "markdown", "markdown": "markdown", "txt": "markdown", "html": "html", "htm": "html", "srt": "subtitle", "vtt": "subtitle", "csv": "csv", "tsv": "csv", "json": "json"}
#: Elements and classes that hold the text of a page. Fixed values.
ROOTS, ROOT_CLASSES = {"main", "article"}, {"content", "docs-content"}


class Page(HTMLParser):
    """The title of a page and the text of the direct children of its roots.

    With within, roots are the main, article and content elements, an inner one
    taking the place of an outer one that has said nothing yet; else the body.
    """

    def __init__(self, within: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.within = within
        self.open: list[tuple[str, bool]] = []
        self.children: list[tuple[str, list[str]]] = []
        self.titles: dict[str, str] = {}
        self.titling: set[str] = set()
        self.base: int | None = None
        self.silent = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        classes = set((dict(attrs).get("class") or "").split())
        gone = tag in DROPPED or bool(classes & DROPPED_CLASSES) or bool(self.open and self.open[-1][1])
        if self.base is not None and len(self.open) == self.base and not gone:
            self.children.append((tag, []))
        self.open.append((tag, gone))
        if tag in ("h1", "title") and tag not in self.titles and not gone:
            self.titles[tag] = ""
            self.titling.add(tag)
        root = tag in ROOTS or bool(classes & ROOT_CLASSES) if self.within else tag == "body"
        if root and not gone and (self.base is None or self.silent):
            self.base, self.silent = len(self.open), True

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]
            if self.base is not None and len(self.open) < self.base:
                self.base, self.silent = None, True
        self.titling.discard(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        for t in self.titling:
            self.titles[t] += data
        if self.base is not None and len(self.open) > self.base and self.children:
            self.children[-1][1].append(data)
            self.silent = self.silent and not data.strip()


def page_sections(html: str, name: str) -> tuple[str, list[tuple[int, str, str]]]:
    """(title, [(depth, title, content)]) of a page: headings among the direct children of its root begin sections.

    The root is the first main, article or content element that holds text, else the body. Text before the first heading and headings without text are left out; a page
    without headings is one section, Content.
    """
    for within in (True, False):
        page = Page(within)
        page.feed(html if "<body" in html.lower() else f"<body>{html}</body>")
        page.close()
        if any(d.strip() for _, data in page.children for d in data):
            break
    out, head, depth, parts = [], "", 1, []
    for tag, data in page.children:
        text = "".join(data).strip()
        if not text:
            continue
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if head and parts:
                out.append((depth, head, "\n\n".join(parts)))
            head, depth, parts = text, int(tag[1]), []
        else:
            parts.append(f"```\n{text}\n```" if tag in ("pre", "code") else text)
    if parts:
        out.append((depth, head, "\n\n".join(parts)) if head else (1, "Content", "\n\n".join(parts)))
    title = page.titles.get("h1", "").strip() or page.titles.get("title", "").strip() or name
    return title, out


def html_sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, sec_no, depth, title, content, page_title): the sections of pages. Null pages give no rows."""
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h in zip(batch["key"], batch["html"]):
                title, sections = page_sections(h, str(k))
                rows += [(k, i, d, t, c, title) for i, (d, t, c) in enumerate(sections, 1)]
            yield pd.DataFrame(rows, columns=["key", "sec_no", "depth", "title", "content", "page_title"])

    ship(df.sparkSession)
    slim = df.where(F.col(html).isNotNull()).select(F.col(key).alias("key"), F.col(html).alias("html"))
    return slim.mapInPandas(work, f"key {kind}, sec_no int, depth int, title string, content string, page_title string").withColumnRenamed("key", key)


def csv_sections(df: DataFrame, key: str, text: str, size: int = 10) -> DataFrame:
    """(key, sec_no, depth, title, content): tables with a header as a section on the schema and one for every `size` rows.

    Blank lines are left out, missing cells read N/A; null texts and texts without a header give no rows.
    """
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                head = t.split("\n", 1)[0]
                lines = [r for r in csv.reader(io.StringIO(t), delimiter="\t" if "\t" in head and "," not in head else ",") if any(c.strip() for c in r)]
                if not lines:
                    continue
                names, cells = lines[0], lines[1:]
                rows.append((k, 0, 1, "Schema", f"This dataset has {len(cells)} rows and {len(names)} columns: {', '.join(names)}."))
                for i in range(0, len(cells), size):
                    shown = [", ".join(f"{n}: {c if c != '' else 'N/A'}" for n, c in zip_longest(names, r[: len(names)], fillvalue="")) for r in cells[i : i + size]]
                    rows.append((k, i // size + 1, 2, f"Rows {i + 1}-{min(i + size, len(cells))}", "\n".join(shown)))
            yield pd.DataFrame(rows, columns=["key", "sec_no", "depth", "title", "content"])

    ship(df.sparkSession)
    slim = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(work, f"key {kind}, sec_no int, depth int, title string, content string").withColumnRenamed("key", key)


def read_texts(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(file, kind, text) of the files under a path, named by their place below it; kind is null for files that cannot be read.

    readers gives for endings such as pdf what makes text of a file's bytes;
    such files are read as papers, with a null text where the reader fails.
    """
    ending = lambda c: F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    below = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), F.lit(r"\A.*?\Q" + f"/{path.split('://')[-1].strip('/')}/" + r"\E"), F.lit(""))
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    rows = rows.where(~ending(F.col("file")).isin(*readers)) if readers else rows
    kinds = F.create_map(*[F.lit(x) for pair in READ_AS.items() for x in pair])
    out = rows.select(below(F.col("file")).alias("file"), kinds[ending(F.col("file"))].alias("kind"), "text")
    for name, extract in (readers or {}).items():
        found = binary_texts(spark, path, extract, f"*.{name}")
        out = out.unionByName(found.select(below(F.col("file")).alias("file"), F.lit("paper").alias("kind"), "text"))
    return out


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, titles, skipped) of text files: (file, sec_no, depth, title, content), (file, title, metadata), and (file, reason) of the others.

    A markdown file's title is its first heading of depth one and its metadata
    its front matter, a page's title its own; other files are titled by their
    name. Null texts of known kinds are skipped too.
    """
    files = materialise(files, "files")
    of = lambda k: files.where((F.col("kind") == k) & F.col("text").isNotNull())
    columns = ["file", "sec_no", "depth", "title", "content"]
    named = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.[A-Za-z0-9]+$", "")
    none = F.create_map().cast("map<string,string>")
    flat = lambda df: df.withColumn("depth", F.lit(1))
    marked = of("markdown").withColumn("body", F.regexp_replace("text", r"(?s)\A---\n.*?\n---[^\n]*\n?", ""))
    pages = materialise(html_sections(of("html"), "file", "text"), "pages")
    cut = lambda k, f: flat(of(k).select("file", F.posexplode(f(F.col("text"))).alias("sec_no", "s")).select("file", "sec_no", "s.title", "s.content"))
    parts = [
        markdown_sections(marked, "file", "body"), pages, cut("subtitle", subtitle_sections), cut("json", json_sections),
        csv_sections(of("csv"), "file", "text"), flat(paper_sections(of("paper"), "file", "text")),
    ]
    sections = reduce(lambda a, b: a.unionByName(b), [p.select(*columns[:1], F.col("sec_no").cast("int"), F.col("depth").cast("int"), *columns[3:]) for p in parts])
    known = files.where(F.col("kind").isNotNull() & F.col("text").isNotNull())
    titles = known.where("kind = 'markdown'").select("file", markdown_title(F.col("text")).alias("title"), front_matter(F.col("text")).alias("metadata"))
    titled = known.where("kind = 'html'").join(pages.groupBy("file").agg(F.max("page_title").alias("title")), "file", "left")
    titles = titles.unionByName(titled.select("file", F.when(F.col("title") == F.col("file"), named).otherwise(F.coalesce("title", named)).alias("title"), none.alias("metadata")))
    titles = titles.unionByName(known.where("kind not in ('markdown', 'html')").select("file", named.alias("title"), none.alias("metadata")))
    reason = F.when(F.col("kind").isNull(), "unknown kind of file").otherwise("no text could be read")
    return sections, titles, files.where(F.col("kind").isNull() | F.col("text").isNull()).select("file", reason.alias("reason"))


def binary_texts(spark: SparkSession, path: str, extract: Callable[[bytes], str], glob: str = "*") -> DataFrame:
    """(file, text) of binary files by an extractor (PDF, image or sound readers); a file that it cannot read has a null text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def safe(content: bytes) -> str | None:
            try:
                return extract(content)
            except Exception:
                return None

        for batch in batches:
            yield pd.DataFrame({"file": batch["path"], "text": [safe(c) for c in batch["content"]]})

    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(work, "file string, text string")


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables of graphs under path, one folder a table, partitioned by graph; saved graphs replace their former state."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, name: str, graph_id: str | None = None) -> DataFrame:
    """One saved table, of one graph if graph_id is given: then only that graph's partition is read."""
    df = spark.read.parquet(f"{path}/{name}").withColumn("graph_id", F.col("graph_id").cast("string"))
    return df if graph_id is None else df.where(F.col("graph_id") == graph_id)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that cannot be read are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
