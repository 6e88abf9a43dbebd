"""Near-duplicate texts by a chosen-path similarity join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.components import connected_components
from knotwork.operators.spread import crowded, join_checked, join_sliced
from knotwork.session import materialise, ship

WORD = re.compile(r"[^\W_]+")
SKETCH_WORDS = 3
SKETCH_BITS = 64 * SKETCH_WORDS
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
ROW = "path long, cls long, " + ", ".join(f"{c} long" for c in SKETCH)


def mix(x: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """A 64-bit mixing function, element by element."""
    x = x.astype(np.uint64) ^ np.asarray(seed, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(nodes: DataFrame, shingle: int, min_words: int, key: str, text: str) -> DataFrame:
    """(key, cls, check, n, tokens): the set of hashed runs of `shingle` words of every text with at least min_words words.

    tokens is the sorted set as packed 32-bit numbers, cls and check are
    64-bit hashes of it: texts with the same set share them.
    """
    kind = dict(nodes.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            if len(known) > 500_000:
                known.clear()
            for k, t in zip(batch["key"], batch["text"]):
                words = WORD.findall(t.lower())
                if len(words) < min_words:
                    continue
                ids = []
                for w in words:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    ids.append(h)
                h = np.array(ids, dtype=np.uint64)
                run = h[: len(h) - shingle + 1]
                for i in range(1, shingle):
                    run = run * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - shingle + 1 + i]
                tokens = np.unique((mix(run) >> np.uint64(32)).astype(np.uint32)).tobytes()
                rows.append((k, xxhash.xxh3_64_intdigest(tokens) - (1 << 63), xxhash.xxh64_intdigest(tokens, 7) - (1 << 63), len(tokens) // 4, tokens))
            yield pd.DataFrame(rows, columns=["key", "cls", "check", "n", "tokens"])

    slim = nodes.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    return slim.mapInPandas(work, f"key {kind}, cls long, check long, n int, tokens binary")


def frequent_tokens(sets: DataFrame, n_sets: int, limit: int, share: int = 2000) -> np.ndarray:
    """The tokens in about max(limit, n_sets / share) sets or more.

    At most (mean set size) x share tokens can reach that, however many sets
    there are. Tasks report the tokens that are frequent among their own sets;
    which tokens pass decides how work is split and not what is found.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, rows = [], 0
        for batch in batches:
            packed += list(batch["tokens"])
            rows += len(batch)
            if rows >= 200_000:
                yield counted(packed, rows)
                packed, rows = [], 0
        if rows:
            yield counted(packed, rows)

    def counted(packed: list[bytes], rows: int) -> pd.DataFrame:
        token, n = np.unique(np.frombuffer(b"".join(packed), dtype=np.uint32), return_counts=True)
        kept = n >= max(1, min(rows / (8 * share), limit * rows / (8 * max(n_sets, 1))))
        return pd.DataFrame({"token": token[kept].astype(np.int64), "n": n[kept]})

    counts = sets.select("tokens").mapInPandas(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= 0.75 * max(limit, n_sets / share)).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.uint32))


def flat(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of many sets in one array, and the size of each set."""
    return np.frombuffer(b"".join(packed), dtype=np.uint32), np.fromiter((len(x) // 4 for x in packed), dtype=np.int64, count=len(packed))


def sketches(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Some 64-bit words for each set: one bit of the least hash under each of SKETCH_BITS hash functions."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    base = mix(tokens)
    out = [np.zeros(len(sizes), dtype=np.uint64) for _ in SKETCH]
    for k in range(SKETCH_BITS):
        h = ((base ^ SEEDS[k]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)
        least = np.minimum.reduceat(h, starts)
        out[k // 64] |= (least & np.uint64(1)) << np.uint64(k % 64)
    return [x.view(np.int64) for x in out]


def path_rows(cls: np.ndarray, sketch: list[np.ndarray], owner: np.ndarray, path: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"path": path.view(np.int64), "cls": cls[owner], **{c: x[owner] for c, x in zip(SKETCH, sketch)}})


#: The low bits of a path: the number of its run, and whether it took more than one step.
RUN, DEEP = np.uint64(15), np.uint64(16)
MARKS = RUN | DEEP


def chosen_paths(tokens: np.ndarray, sizes: np.ndarray, owner: np.ndarray, path: np.ndarray, spread: float, frequent: np.ndarray, depth: int, deep: bool = False) -> list[np.ndarray]:
    """(owner, path) one step further for sets that share a path, and further yet where the step is a frequent token.

    A token of a set of n is taken if its hash under the path is below
    spread / n: sets that share the path and the token take the same step.
    A step over a frequent token splits too little and is split again at once.
    The low bits of a path keep its run and mark it as deep after a second step.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    done = []
    for level in range(depth):
        n = sizes[owner]
        rows = np.repeat(np.arange(len(owner)), n)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[owner], n)
        step = mix(tokens[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), path[rows])
        taken = step < (np.minimum(spread / n, 1.0) * float(2**64 - 2048)).astype(np.uint64)[rows]
        rows, token, step = rows[taken], tokens[at[taken]], step[taken]
        mark = (path[rows] & RUN) | (DEEP if deep or level else np.uint64(0))
        owner, path = owner[rows], (mix(step, path[rows]) & ~MARKS) | mark
        again = np.isin(token, frequent, assume_unique=False) if level < depth - 1 and len(frequent) else np.zeros(len(token), dtype=bool)
        done.append((owner[~again], path[~again]))
        owner, path = owner[again], path[again]
        if not len(owner):
            break
    return [np.concatenate(x) for x in zip(*done)]


def bucket_pairs(batches: Iterator[pd.DataFrame], limit: int, least_bits: int) -> Iterator[pd.DataFrame]:
    """Of rows sorted by path: the pairs of small buckets whose sketches agree (kind 0) with their run and depth, the rows of large ones (kind 1)."""
    rest = None
    for batch in batches:
        x = np.column_stack([batch[c].to_numpy(np.int64) for c in ("path", "cls", *SKETCH)])
        x = x if rest is None else np.concatenate([rest, x])
        end = int(np.searchsorted(x[:, 0], x[-1, 0])) if len(x) else 0
        if len(x) - end > limit + 1:  # of a bucket that is large already, all but the first rows can go
            yield from resolved(x[:end], limit, least_bits)
            over = x[end:]
            yield large(over[limit + 1 :])
            rest = over[: limit + 1]
        else:
            yield from resolved(x[:end], limit, least_bits)
            rest = x[end:]
    if rest is not None and len(rest):
        yield from resolved(rest, limit, least_bits)


def large(x: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.ones(len(x), dtype=np.int32), "a": x[:, 0], "b": x[:, 1], "mark": np.zeros(len(x), dtype=np.int32)})


def resolved(x: np.ndarray, limit: int, least_bits: int) -> Iterator[pd.DataFrame]:
    if not len(x):
        return
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])
    starts = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]]))
    size = np.diff(np.append(starts, len(x)))
    big = np.repeat(size > limit, size)
    if big.any():
        yield large(x[big])
    x = x[~big & new]
    if not len(x):
        return
    starts = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]]))
    left = np.repeat(np.append(starts[1:], len(x)), np.diff(np.append(starts, len(x)))) - np.arange(len(x)) - 1
    at, d = np.flatnonzero(left >= 1), 1
    s = x[:, 2:].view(np.uint64)
    a, b = [], []
    while len(at):
        other = at + d
        unlike = np.bitwise_count(s[at] ^ s[other]).sum(axis=1, dtype=np.int16)
        ok = SKETCH_BITS - unlike >= least_bits
        a.append(at[ok])
        b.append(other[ok])
        d += 1
        at = at[left[at] >= d]
    if a:
        mark = x[np.concatenate(a), 0] & np.int64(MARKS)
        a, b = x[np.concatenate(a), 1], x[np.concatenate(b), 1]
        yield pd.DataFrame({"kind": np.zeros(len(a), dtype=np.int32), "a": np.minimum(a, b), "b": np.maximum(a, b), "mark": mark.astype(np.int32)})


def shared_share(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose sets have at least threshold of their union in common, with it as similarity."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            (x, n), (y, m) = flat(list(batch["x"])), flat(list(batch["y"]))
            row = np.arange(len(batch), dtype=np.uint64) << np.uint64(32)
            both = np.concatenate([np.repeat(row, n) | x, np.repeat(row, m) | y])
            both.sort()
            same = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
            common = np.bincount(same.astype(np.int64), minlength=len(batch))
            similarity = common / np.maximum(n + m - common, 1)
            kept = common >= threshold * (n + m - common)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": similarity})[kept]

    x = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    hot_a, hot_b = crowded(pairs, ["a"]), crowded(pairs, ["b"])
    met = join_checked(join_checked(pairs, x, ["a"], hot_a), y, ["b"], hot_b)
    return met.select("a", "b", "x", "y").mapInPandas(work, "a long, b long, similarity double")


def apart(sets: DataFrame) -> DataFrame:
    """sets in which texts of one class have the same set by a second hash too; others get a class of their own."""
    clash = sets.groupBy("cls").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("cls", "lo")
    if clash.isEmpty():
        return sets
    cls = F.when(F.col("lo").isNull() | (F.col("check") == F.col("lo")), F.col("cls")).otherwise(F.xxhash64("cls", "check"))
    return materialise(sets.join(clash, "cls", "left").withColumn("cls", cls).drop("lo"), "sets")


def estimated_recall(found: DataFrame) -> float:
    """The share of all pairs that were found, from the pairs (runs, deep) that one run and that two runs met (Chao's estimate), for deep and other paths apart."""
    met = F.bit_count("runs")
    rows = found.groupBy("deep").agg(F.count(F.lit(1)).alias("n"), F.count_if(met == 1).alias("once"), F.count_if(met == 2).alias("twice")).collect()
    n = sum(r["n"] for r in rows)
    unseen = sum(r["once"] * (r["once"] - 1) / (2 * (r["twice"] + 1)) for r in rows)
    return n / (n + unseen) if n else 1.0


def near_copies(
    nodes: DataFrame,
    threshold: float = 0.5,
    shingle: int = 3,
    min_words: int = 20,
    key: str = "node_id",
    text: str = "content",
    recall: float = 0.999,
    runs: int = 8,
    limit: int = 300,
    max_levels: int = 6,
    most_batches: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): every text's class of equal word-run sets, and the pairs of classes at least threshold alike.

    A chosen-path join. Each set takes steps over tokens that it shares with
    its like: in each independent run a set of n tokens takes those whose seeded
    hash is below 1 / (threshold n), so that two sets at the threshold expect one
    common step or more in every run. Sets on one path are a bucket. Steps over
    frequent tokens are split again at once. Buckets of up to `limit` sets are
    compared pair by pair by 192-bit sketches; larger ones take another step, and
    those that remain after max_levels are compared in full, in blocks.
    Candidates are verified on the whole sets.

    Runs are made in batches of `runs`, until the recall estimated from how many
    runs met each verified pair, for paths of one step and deeper ones apart,
    reaches `recall`; most_batches batches without it raise an error. A pair at
    the threshold that parts after one step is missed by eight runs with a
    chance of about e^-8; one that must survive 3, 6 or 11 steps, each of which
    it passes just about once, with up to 2, 12 or 28 % (more batches follow if
    many do); the sketch misses about 1 in 8,000.

    Null, short and empty texts belong to no class; repeated rows and exact
    copies share a class and are compared once; no pair within a class is
    listed in links; an empty table gives empty results.
    """
    ship(nodes.sparkSession)
    sets = apart(materialise(shingle_sets(nodes, shingle, min_words, key, text), "sets"))
    one_each = sets.dropDuplicates(["cls"]).select("cls", "tokens")
    n_sets = sets.count()
    frequent = frequent_tokens(sets, n_sets, limit)
    sent = sets.sparkSession.sparkContext.broadcast(frequent)
    spread = 1.0 / threshold
    least_bits = int(np.floor(SKETCH_BITS * (1 + threshold) / 2 - 3.67 * np.sqrt(SKETCH_BITS * (1 - threshold**2) / 4)))

    def first_paths(batch_no: int):
        seeds = (SEEDS[1000 + batch_no * runs : 1000 + (batch_no + 1) * runs] & ~MARKS) | np.arange(runs, dtype=np.uint64)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            for batch in batches:
                new = [i for i, c in enumerate(batch["cls"]) if c not in seen and not seen.add(c)]
                if len(seen) > 1_000_000:
                    seen.clear()
                for lo in range(0, len(new), 4096):
                    part = batch.iloc[new[lo : lo + 4096]]
                    tokens, sizes = flat(list(part["tokens"]))
                    sketch = sketches(tokens, sizes)
                    owner = np.tile(np.arange(len(part)), runs)
                    owner, path = chosen_paths(tokens, sizes, owner, np.repeat(seeds, len(part)), spread, sent.value, max_levels)
                    yield path_rows(part["cls"].to_numpy(), sketch, owner, path)

        return work

    def next_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens, sizes = flat(list(batch["tokens"]))
            sketch = sketches(tokens, sizes)
            start = batch["path"].to_numpy(np.int64).view(np.uint64)
            owner, path = chosen_paths(tokens, sizes, np.arange(len(batch)), start, spread, np.empty(0, np.uint32), 1, True)
            yield path_rows(batch["cls"].to_numpy(), sketch, owner, path)

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return bucket_pairs(batches, limit, least_bits)

    def candidates(batch_no: int) -> DataFrame:
        """(a, b, mark) of the pairs that the runs of a batch propose."""
        rows = sets.select("cls", "tokens").mapInPandas(first_paths(batch_no), ROW)
        pairs = None
        for level in range(1, max_levels + 1):
            done = rows.repartition("path").sortWithinPartitions("path", "cls").mapInPandas(resolve, "kind int, a long, b long, mark int")
            done = materialise(done, f"level-{level}")
            found = done.where("kind = 0").select("a", "b", "mark")
            pairs = found if pairs is None else pairs.unionByName(found)
            over = done.where("kind = 1").select(F.col("a").alias("path"), F.col("b").alias("cls")).distinct()
            if over.isEmpty():
                break
            if level == max_levels:
                whole = all_in_blocks(over).select("a", "b", F.col("path").bitwiseAND(int(MARKS)).cast("int").alias("mark"))
                pairs = pairs.unionByName(whole)
                break
            rows = over.join(one_each, "cls").mapInPandas(next_paths, ROW)
        return pairs

    links = None
    for batch_no in range(most_batches):
        run = F.expr("shiftleft(1L, mark & 15)")
        met = candidates(batch_no).groupBy("a", "b").agg(F.bit_or(run).alias("runs"), F.min(F.col("mark").bitwiseAND(16)).alias("deep"))
        if links is not None:
            met = met.join(links.select("a", "b"), ["a", "b"], "left_anti")
        met = materialise(met, "met")
        found = shared_share(met.select("a", "b"), one_each, threshold).join(met, ["a", "b"])
        found = materialise(found, "links")
        links = found if links is None else links.unionByName(found)
        if estimated_recall(found) >= recall:
            members = sets.select(F.col("key").alias(key), "cls").distinct()
            return members, links.select("a", "b", "similarity")
    raise RuntimeError(f"an estimated recall of {recall} was not reached in {most_batches * runs} runs")


def all_in_blocks(over: DataFrame, block: int = 500) -> DataFrame:
    """Every pair of classes of one path, met in one of the path's pairs of blocks of about `block` classes."""
    counts = over.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    placed = over.join(counts, "path").withColumn("i", F.pmod(F.xxhash64("cls"), "blocks"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = placed.withColumn("j", others).select("path", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "cls")
    x, y = met.withColumnRenamed("cls", "a"), met.withColumnRenamed("cls", "b")
    return x.join(y, ["path", "lo", "hi"]).where("a < b").select("path", "a", "b")


def near_copy_pairs(nodes: DataFrame, key: str = "node_id", **options) -> DataFrame:
    """(node_a, node_b) of every two texts at least threshold alike, copies included (options: see near_copies)."""
    members, links = near_copies(nodes, key=key, **options)
    copied = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = links.select("a", "b").unionByName(copied.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    x = members.select(F.col("cls").alias("a"), F.col(key).alias("x"))
    y = members.select(F.col("cls").alias("b"), F.col(key).alias("y"))
    met = join_sliced(join_sliced(pairs, x, ["a"]), y, ["b"]).where("x <> y")
    return met.select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b")).distinct()


def near_copy_groups(nodes: DataFrame, key: str = "node_id", **options) -> DataFrame:
    """(key, class_id, group_id, n_copies, n_links): one row for every text of at least min_words words.

    class_id: texts with equal sets; n_copies: how many there are; n_links: how
    many other classes are at least threshold alike; group_id: the smallest
    class id that is reached over such links.
    """
    members, links = near_copies(nodes, key=key, **options)
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n_copies"))
    ends = links.select(F.col("a").alias("cls")).unionAll(links.select(F.col("b").alias("cls")))
    degree = ends.groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    groups = connected_components(links).select(F.col("id").alias("cls"), F.col("component").alias("group_id"))
    classes = sizes.join(degree, "cls", "left").join(groups, "cls", "left")
    return members.join(classes, "cls").select(
        key, F.col("cls").alias("class_id"), F.coalesce("group_id", "cls").alias("group_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
