"""Cutting long texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places where a text may be cut, from the strongest pause to the weakest; a cut comes after the match. Fixed values.
LEVELS = [
    ("section", re.compile(r"\n(?=#{1,6} )")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("sentence", re.compile(r"(?:[.!?][\"')\]*]*[ \t\r]+|[.!?]?\r?\n|。)")),
    ("word", re.compile(r"(?=[ \t\r\n])|(?<=[ \t\r\n。])")),
]
RUN = re.compile(r"[^ \t\r\n。]+")


def atoms(text: str, low: int, high: int, room: int, level: int = 0, closing: str = "end") -> Iterator[tuple[int, str]]:
    """Ends of the stretches of text[low:high] that fit into room, each with the level it was cut at.

    A stretch that fits stays whole; one that does not is cut at the next
    weaker level, and last after every `room` characters.
    """
    if high - low <= room:
        yield high, closing
    elif level == len(LEVELS):
        for end in range(low + room, high, room):
            yield end, "character"
        yield high, closing
    else:
        name, pattern = LEVELS[level]
        start = low
        for m in pattern.finditer(text, low, high):
            if start < m.end() < high:
                yield from atoms(text, start, m.end(), room, level + 1, name)
                start = m.end()
        yield from atoms(text, start, high, room, level + 1, closing)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut) of the pieces of a text; the last ends at level end.

    Pieces have at most limit characters and each begins overlap characters
    before the end of the one before it.
    """
    if len(text) <= limit:
        return [(0, len(text), "end")]
    pieces, start, end, at = [], 0, 0, "end"
    for to, name in atoms(text, 0, len(text), limit - overlap):
        if to - start > limit:
            pieces.append((start, end, at))
            start = end - overlap
        end, at = to, name
    return [*pieces, (start, end, at)]


def split_texts(df: DataFrame, limit: int = 1200, overlap: int = 120, key: str = "node_id", text: str = "content", section: str = "section") -> DataFrame:
    """The pieces of every text longer than limit: (key, section, piece_no, start, end, cut, forced, piece).

    A text is cut by a hierarchy of separators (section, paragraph, sentence,
    word, character): stretches that are too long are cut again at the next
    level, and neighbours are packed greedily up to limit with `overlap`
    characters shared by consecutive pieces. cut is the level a piece ends at;
    forced is 1 if the text has more than limit characters without a pause.

    Rows with null or short texts give no pieces; a null section stays null;
    repeated rows of one key give the pieces once (of its largest text); extra
    columns are ignored; an empty table gives no rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and limit")
    long = df.where(F.length(text) > limit).groupBy(F.col(key).alias("key")).agg(F.max(F.struct(F.col(text).alias("text"), F.col(section).alias("section"))).alias("t"))
    long = long.select("key", F.col("t.text").alias("text"), F.col("t.section").alias("section"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, s, t in zip(batch["key"], batch["section"], batch["text"]):
                forced = int(any(m.end() - m.start() > limit for m in RUN.finditer(t)))
                rows += [(k, s, i, a, b, at, forced, t[a:b]) for i, (a, b, at) in enumerate(cuts(t, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=["key", "section", "piece_no", "start", "end", "cut", "forced", "piece"])

    kind = df.schema[key].dataType.simpleString()
    out = long.mapInPandas(work, f"key {kind}, section string, piece_no int, start int, end int, cut string, forced int, piece string")
    return out.withColumnRenamed("key", key)
