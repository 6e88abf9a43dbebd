"""Finding held-out test passages inside a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.spread import join_sliced
from knotwork.session import materialise, ship

WORD = re.compile(r"[^\W_]+")
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Places of a table that lie in one chunk when it is gathered.
CHUNK_BITS = 16


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits of a text, in lower case."""
    return WORD.findall(text.lower()) if text else []


class Codes:
    """64-bit codes of words, and from them those of blocks of two words and of runs."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def of(self, said: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in {*said}.difference(known):
            known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, said), dtype=np.uint64, count=len(said))

    @staticmethod
    def blocks(code: np.ndarray) -> np.ndarray:
        """The code of every two words that follow each other, by the first."""
        x = code[:-1] * MIX + code[1:]
        return (x ^ (x >> np.uint64(29))) * STEP

    def runs(self, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The code of the run of `width` words at each start."""
        x = code[starts]
        for i in range(1, self.width):
            x = x * MIX + code[starts + i]
        return (x ^ (x >> np.uint64(31))) * STEP


def item_runs(items: DataFrame, columns: list[str], width: int) -> DataFrame:
    """(run, words, item_id): every run of `width` words of the test texts, by its code."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(width)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part, rows = batch.iloc[lo : lo + 256], []
                for item, *texts in part[["item_id", *columns]].itertuples(index=False):
                    for text in texts:
                        w = words(text)
                        if len(w) >= width:
                            code = codes.of(w)
                            run = codes.runs(code, np.arange(len(w) - width + 1)).view(np.int64)
                            rows += [(r, " ".join(w[i : i + width]), item) for i, r in enumerate(run.tolist())]
                yield pd.DataFrame(rows, columns=["run", "words", "item_id"])

    kind = dict(items.dtypes)["item_id"]
    return items.mapInPandas(work, f"run long, words string, item_id {kind}").distinct()


def shift_table(runs: DataFrame, width: int, bits: int) -> np.ndarray:
    """For each of 2^bits places: how far the window may move if its last block falls there; width - 1 if no pattern has such a block.

    Blocks that share a place share the least shift, so that the table has one
    size however many patterns there are and never skips one.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(width)
        for batch in batches:
            places = [codes.blocks(codes.of(t.split(" "))) & np.uint64((1 << bits) - 1) for t in batch["words"]]
            rows = pd.DataFrame({"place": np.concatenate(places).astype(np.int64) if places else [], "shift": np.tile(np.arange(width - 2, -1, -1), len(places))})
            yield rows.groupby("place", as_index=False)["shift"].min()

    least = runs.select("words").distinct().mapInPandas(work, "place long, shift int").groupBy("place").agg(F.min("shift").alias("v"))
    return gathered(least, bits, width - 1)


def run_marks(runs: DataFrame, bits: int) -> np.ndarray:
    """For each of 2^bits places whether a pattern's code falls there."""
    marks = runs.select(F.pmod("run", F.lit(1 << bits)).alias("place")).distinct().withColumn("v", F.lit(1))
    return gathered(marks, bits, 0)


def gathered(rows: DataFrame, bits: int, usual: int) -> np.ndarray:
    """A table of 2^bits bytes from rows (place, v), put together in chunks by tasks."""
    size = 1 << min(bits, CHUNK_BITS)

    def chunk(part: pd.DataFrame) -> pd.DataFrame:
        out = np.full(size, usual, dtype=np.uint8)
        out[part["place"].to_numpy() % size] = part["v"].to_numpy()
        return pd.DataFrame({"chunk": [part["place"].iloc[0] // size], "v": [out.tobytes()]})

    table = np.full(1 << bits, usual, dtype=np.uint8)
    for r in rows.groupBy(F.floor(F.col("place") / size)).applyInPandas(chunk, "chunk long, v binary").toLocalIterator():
        table[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["v"], dtype=np.uint8)
    return table


def occurrences(code: np.ndarray, ends: list[int], codes: Codes, shift: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, codes) of the runs that may be patterns, in texts that lie one after another and end at `ends`: where the window stops and the run's own place is marked."""
    width = codes.width
    if len(code) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    steps, stops, first = shift[codes.blocks(code) & np.uint64(len(shift) - 1)].tolist(), [], 0
    for end in ends:
        at, last = first + width - 2, end - 1
        while at < last:
            step = steps[at]
            if step:
                at += step
            else:
                stops.append(at)
                at += 1
        first = end
    starts = np.array(stops, dtype=np.int64) - (width - 2)
    run = codes.runs(code, starts)
    kept = marks[run & np.uint64(len(marks) - 1)] > 0
    return starts[kept], run[kept]


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_texts: tuple[str, ...] = ("passage", "question"),
    width: int = 12,
    most_bits: int = 26,
) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least `width` consecutive words of an item's texts.

    Wu-Manber over words: every run of `width` words of the items is a pattern.
    Words are maximal runs of letters and digits in lower case, so that mark-up
    and line breaks between them do not matter. Tasks make the patterns, the
    shift table by blocks of two words, and the marks of the patterns' codes; the
    two tables have 16 bytes for each pattern, 2^most_bits bytes at most, and are
    all that is broadcast. The documents are scanned once, where they lie, however many
    items there are: the window moves by the shift of its last block, and where
    it stops a run with a marked code is a candidate. Candidates meet the
    patterns by code, and their words are compared.

    Null and empty texts hold nothing; items with fewer than width words cannot
    leak; items sharing a passage are all reported; repeated documents and
    items give one row; extra columns are ignored.
    """
    if width < 3:
        raise ValueError("width must be at least 3")
    ship(docs.sparkSession)
    columns = [f"t{i}" for i in range(len(item_texts))]
    keyed = items.select(F.col(item_id).alias("item_id"), *[F.col(c).alias(t) for c, t in zip(item_texts, columns)])
    runs = materialise(item_runs(keyed, columns, width), "runs")
    bits = min(max(CHUNK_BITS, (16 * runs.count()).bit_length()), most_bits)
    send = docs.sparkSession.sparkContext.broadcast
    tables = send((shift_table(runs, width, bits), run_marks(runs, bits)))
    kind = dict(docs.dtypes)[doc_id]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, (shift, marks) = Codes(width), tables.value
        for batch in batches:
            for lo in range(0, len(batch), 500):
                said, ends = [], []
                for t in batch["text"].iloc[lo : lo + 500]:
                    said += words(t)
                    ends.append(len(said))
                starts, run = occurrences(codes.of(said), ends, codes, shift, marks)
                doc = batch["doc_id"].to_numpy()[lo + np.searchsorted(np.array(ends), starts, side="right")]
                found = pd.DataFrame({"doc_id": doc, "run": run.view(np.int64), "said": pd.Series([" ".join(said[i : i + width]) for i in starts.tolist()], dtype=object)})
                yield found.drop_duplicates()

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    held = materialise(slim.mapInPandas(work, f"doc_id {kind}, run long, said string"), "held")
    met = join_sliced(runs, held, ["run"]).where("words = said")
    return met.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id)).distinct()
