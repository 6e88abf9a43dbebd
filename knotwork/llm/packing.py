"""Filling containers of fixed capacity with whole texts."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import materialise, ship

#: How byte_bpe_50k cuts a text into words before merging. Fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TIERS = (256, 512, 1024, 2048)


def encoder(path: str):
    """The public tokenizer whose ranks lie at path."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized_parts(docs: DataFrame, capacity: int, vocabulary: str, doc_id: str, text: str) -> DataFrame:
    """(doc_id, part_no, n_tokens, row_no): the parts to place, numbered over all partitions."""
    kind = dict(docs.dtypes)[doc_id]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, row = encoder(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"]):
                n = len(enc.encode_ordinary(t)) if t else 0
                for part, at in enumerate(range(0, max(n, 1), capacity)):
                    rows.append((d, part, min(capacity, n - at), row))
                    row += 1
            yield pd.DataFrame(rows, columns=["doc_id", "part_no", "n_tokens", "row_no"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInPandas(work, f"doc_id {kind}, part_no int, n_tokens int, row_no long")


class Stock:
    """How many parts of each size are left to place, and how many of each were placed."""

    def __init__(self, sizes: dict[int, int]) -> None:
        self.left = {s: n for s, n in sizes.items() if s > 0 and n > 0}
        self.sizes = sorted(self.left)

    def fill(self, gap: int, first: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The longest parts that fit into a gap, one after another, and what stays empty; first opens it."""
        pattern, at = [], bisect_right(self.sizes, gap if first is None else first) - 1
        while at >= 0:
            size = self.sizes[at]
            n = min(self.left[size], gap // size)
            if n:
                pattern.append((size, n))
                gap -= n * size
            at = min(at, bisect_right(self.sizes, gap)) - 1
        return pattern, gap

    def take(self, pattern: list[tuple[int, int]], times: int) -> None:
        for size, n in pattern:
            self.left[size] -= n * times
            if not self.left[size]:
                del self.left[size]
                self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def times(self, pattern: list[tuple[int, int]]) -> int:
        return min(self.left[size] // n for size, n in pattern)

    def longest(self, low: int, high: int) -> int | None:
        """The longest size above low and up to high."""
        at = bisect_right(self.sizes, high) - 1
        return self.sizes[at] if at >= 0 and self.sizes[at] > low else None


def packing_plan(sizes: dict[int, int], capacity: int, tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int]], int, int]]:
    """[(window, pattern, times, container)]: how windows of several lengths are filled, and the first container of each.

    sizes counts the parts by size; each tier holds the sizes up to its window
    and above the next shorter one's. From the longest tier to the shortest, each
    part of a tier opens a window, which takes the longest parts that still fit,
    of its own tier and then of shorter ones. A window of the longest tier is a
    container and stays as it is. Shorter ones stay if they are exactly full;
    the longest part of one that is not waits. Before the shortest tier, parts
    that wait open containers of their own, filled from that tier; at the end
    those of the shortest tier do. Full windows lie side by side in containers,
    the longest first, and the room that they leave in the last is filled too.
    A way of filling is used as often as the counts allow, so that the plan has
    some rows for each size and does not grow with the parts.
    """
    stock, waiting = Stock(sizes), {}
    made: list[tuple[int, list[tuple[int, int]], int]] = []

    def open_containers() -> None:
        nonlocal waiting
        for size, n in waiting.items():
            stock.left[size] = stock.left.get(size, 0) + n
        stock.sizes, opened, waiting = sorted(stock.left), set(waiting), {}
        for size in sorted(opened, reverse=True):
            while size in stock.left:
                pattern, _ = stock.fill(capacity, size)
                times = stock.times(pattern)
                stock.take(pattern, times)
                made.append((capacity, pattern, times))

    for i in range(len(tiers) - 1, -1, -1):
        window, below = tiers[i], tiers[i - 1] if i else 0
        if i == 0 and window < capacity:
            open_containers()
        while (first := stock.longest(below, window)) is not None:
            pattern, gap = stock.fill(window, first)
            times = stock.times(pattern)
            if gap and window < capacity:
                waiting[first] = waiting.get(first, 0) + stock.left[first]
                stock.take([(first, 1)], stock.left[first])
            else:
                stock.take(pattern, times)
                made.append((window, pattern, times))
    out, container, used = [], 0, 0
    for window, pattern, times in sorted(made, key=lambda m: -m[0]):  # windows of one length fit a container evenly
        at = container * capacity + used
        out.append((window, pattern, times, at))
        container, used = divmod(at + window * times, capacity)
    if waiting and used:
        for size, n in waiting.items():
            stock.left[size] = stock.left.get(size, 0) + n
        stock.sizes, waiting = sorted(stock.left), {}
        pattern, _ = stock.fill(capacity - used)
        if pattern:
            stock.take(pattern, 1)
            out.append((capacity, pattern, 1, container * capacity + used))
    rest = {**stock.left}
    for size, n in waiting.items():
        rest[size] = rest.get(size, 0) + n
    stock, at = Stock(rest), -(-(container * capacity + used) // capacity) * capacity
    while stock.sizes:
        pattern, _ = stock.fill(capacity)
        times = stock.times(pattern)
        stock.take(pattern, times)
        out.append((capacity, pattern, times, at))
        at += capacity * times
    return out


def placed(parts: pd.DataFrame, capacity: int, tiers: tuple[int, ...], group_windows: int) -> pd.DataFrame:
    """parts with the container, window and step group of each, numbered from 0, by the packing plan of their sizes.

    Containers are dealt to the groups in turn, sorted by their longest window
    and then by tokens, forth and back, so that groups have the same mix and
    about as many tokens.
    """
    order = np.lexsort((parts["row_no"].to_numpy(), parts["n_tokens"].to_numpy()))
    size = parts["n_tokens"].to_numpy()[order]
    kinds, first, counts = np.unique(size, return_index=True, return_counts=True)
    next_of = dict(zip(kinds.tolist(), first.tolist()))
    container, window = np.full(len(parts), -1, dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
    for length, pattern, times, at in packing_plan(dict(zip(kinds.tolist(), counts.tolist())), capacity, tiers):
        where = (at + length * np.arange(times)) // capacity
        for kind, n in pattern:
            rows = order[next_of[kind] : next_of[kind] + n * times]
            container[rows], window[rows] = np.repeat(where, n), length
            next_of[kind] += n * times
    held = container >= 0
    groups = np.full(len(parts), -1, dtype=np.int64)
    if held.any():
        n = int(container.max()) + 1
        tokens = np.bincount(container[held], weights=parts["n_tokens"].to_numpy()[held], minlength=n)
        longest = np.zeros(n, dtype=np.int64)
        np.maximum.at(longest, container[held], window[held])
        n_groups = max(1, -(-n // group_windows))
        turn = np.arange(n)
        forth = turn % (2 * n_groups)
        dealt = np.empty(n, dtype=np.int64)
        dealt[np.lexsort((tokens, longest))] = np.where(forth < n_groups, forth, 2 * n_groups - 1 - forth)
        groups[held] = dealt[container[held]]
    return pd.DataFrame({"container": container, "tier": window, "step": groups}, index=parts.index)


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    vocabulary: str = VOCABULARY,
    tiers: tuple[int, ...] = TIERS,
    group_windows: int = 64,
    slice_parts: int = 50_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, part_no, n_tokens, container_id, tier, step_group): every text assigned to a container.

    Sizes are tokens of the public tokenizer at `vocabulary` (a path that every
    executor has). Only a text that alone exceeds the capacity is divided, into
    full parts and a rest. Parts are dealt to slices of about slice_parts, and
    each slice is packed in one task: routed to the tiers by length, every tier
    packed in windows of its own length with gaps filled from shorter tiers (see
    packing_plan); tier is the length of the window that a part lies in. A slice
    leaves at most its last container unfilled. Containers are dealt to step
    groups of about group_windows with the same mix of windows and tokens. Of the
    slices the driver sees only how many containers and groups each has.

    Null and empty texts have 0 tokens and no container. Repeated rows are
    placed as often as they occur. Extra columns are ignored. An empty table
    gives no rows. Every tier must divide the next one, and the last be the capacity.
    """
    if tiers[-1] != capacity or any(b % a for a, b in zip(tiers, tiers[1:])):
        raise ValueError("every tier must divide the next one, and the last must be the capacity")
    spark = ship(docs.sparkSession)
    parts = materialise(sized_parts(docs, capacity, vocabulary, doc_id, text), "parts")
    n_slices = -(-parts.count() // slice_parts) or 1
    kind = dict(docs.dtypes)[doc_id]

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([rows[["doc_id", "part_no", "n_tokens", "slice"]], placed(rows, capacity, tiers, group_windows)], axis=1)

    sliced = parts.withColumn("slice", F.pmod(F.xxhash64("row_no"), F.lit(n_slices)))
    packed = sliced.groupBy("slice").applyInPandas(pack, f"doc_id {kind}, part_no int, n_tokens int, slice long, container long, tier long, step long")
    packed = materialise(packed, "packed")
    ends = packed.groupBy("slice").agg((F.max("container") + 1).alias("c"), (F.max("step") + 1).alias("g")).orderBy("slice").toPandas()
    before = spark.createDataFrame(
        [(int(s), int(c), int(g)) for s, c, g in zip(ends["slice"], ends["c"].cumsum() - ends["c"], ends["g"].cumsum() - ends["g"])], "slice long, c long, g long"
    )
    out = packed.join(before, "slice")
    held = F.col("container") >= 0
    return out.select(
        F.col("doc_id").alias(doc_id), "part_no", "n_tokens", F.when(held, F.col("container") + F.col("c")).alias("container_id"), F.when(held, F.col("tier")).cast("int").alias("tier"),
        F.when(held, F.col("step") + F.col("g")).alias("step_group"),
    )
