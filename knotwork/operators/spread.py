"""Keys that hold a large share of the rows, and ranking inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.session import materialise


def hot_keys(counts: DataFrame, total: int, share: int = 1000, floor: int = 50_000, n: str = "n") -> DataFrame:
    """The keys of a (key, n) table with more than 1/share of all rows and more than floor rows.

    There can be at most `share` such keys whatever the size of the data, so
    the result may be broadcast.
    """
    return counts.where(F.col(n) > F.lit(max(floor, total // share)))


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """left joined to right (unique on keys), with the hot keys of left joined by broadcast.

    hot holds at most a bounded number of keys (see hot_keys), so right
    restricted to it is bounded too; the other keys go through a shuffle.
    """
    hot = F.broadcast(hot.select(*keys).distinct())
    cold = left.join(hot, keys, "left_anti").join(right, keys, how)
    warm = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return cold.unionByName(warm)


def crowded(df: DataFrame, keys: list[str], floor: int = 50_000) -> DataFrame | None:
    """The hot keys of df, at most 1,000; None if there are none. Reads df once, with counts combined before the shuffle."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("n"), F.sum("n").alias("total")).first()
    if not most["n"] or most["n"] <= max(floor, most["total"] // 1000):
        return None
    return hot_keys(sizes, most["total"], floor=floor).select(*keys)


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined to right (unique on keys): plainly, or apart for the hot keys of left that crowded() found."""
    return left.join(right, keys, how) if hot is None else join_spread(left, right, keys, hot, how)


def rank_in_slices(df: DataFrame, key: str, order: list, size: int = 50_000) -> DataFrame:
    """df with `local_no`, the row number within (key, slice), and `slice`.

    A key of ordinary size is one slice. The hot keys (see crowded) are cut into
    ranges of about `size` rows by all columns of order, the bounds taken from
    the rows themselves, so that neither bursts nor outlying places put a whole
    key into one task; beyond 10,000 ranges the ranges grow. The number of a row
    in its key is local_no plus the rows of the slices before, which the caller
    adds from the slice counts.
    """
    within = F.row_number().over(Window.partitionBy(key, "slice").orderBy(*order))
    hot = crowded(df, [key], size)
    if hot is None:
        return df.withColumn("slice", F.lit(0)).withColumn("local_no", within)
    hot = F.broadcast(hot)
    warm = df.join(hot, key, "left_semi")
    ranges = min(10_000, -(-warm.count() // size) or 1)
    warm = materialise(warm.repartitionByRange(ranges, key, *order).withColumn("slice", F.spark_partition_id()), "slices")
    cold = df.join(hot, key, "left_anti").withColumn("slice", F.lit(0))
    return cold.unionByName(warm).withColumn("local_no", within)


def next_in_group(df: DataFrame, keys: list[str], order: list[str], item: str, ahead: int, floor: int = 50_000) -> DataFrame:
    """(keys, x, y, step): every item with the up to `ahead` items that follow it in its group.

    order ends in a unique column. Groups of ordinary
    size are read in one window; a group with more than floor rows and more than
    a thousandth of all is numbered in slices, and its items meet by number, so
    that no task reads it whole. Null keys form groups as other values do.
    """
    hot = crowded(df, keys, floor)
    place = Window.partitionBy(*keys).orderBy(*order)
    later = F.array(*[F.struct(F.lit(i).alias("step"), F.lead(item, i).over(place).alias("y")) for i in range(1, ahead + 1)])

    def windowed(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("_later", later).select(*keys, F.col(item).alias("x"), F.explode("_later").alias("_l"))
        return met.select(*keys, "x", "_l.y", "_l.step").where(F.col("y").isNotNull())

    if hot is None:
        return windowed(df)
    one = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys])
    hot = F.broadcast(hot.select(one.alias("_key")))
    marked = df.withColumn("_key", one)
    cold = windowed(marked.join(hot, "_key", "left_anti"))
    ranked = rank_in_slices(marked.join(hot, "_key", "left_semi"), "_key", order, floor)
    counts = ranked.groupBy("_key", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_key", "slice", before.alias("before"))
    numbered = ranked.join(counts, ["_key", "slice"]).withColumn("_no", F.col("before") + F.col("local_no"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(ahead)))
    y = numbered.select("_key", F.col(item).alias("y"), "_no", steps.alias("step")).select("_key", "y", "step", (F.col("_no") - F.col("step")).alias("_no"))
    return cold.unionByName(numbered.select("_key", *keys, F.col(item).alias("x"), "_no").join(y, ["_key", "_no"]).select(*keys, "x", "y", "step"))


def met_in_blocks(df: DataFrame, keys: list[str], block: int = 500, n: str | None = None, hint: str | None = None) -> DataFrame:
    """(keys, x, y): every two items x < y of a key in a table (keys, item), met in one of the key's pairs of blocks of about `block` items.

    n names a column with about the number of items of the key; without it they are counted. hint is how Spark is to join, as in DataFrame.hint.
    """
    hinted = lambda right: right.hint(hint) if hint else right
    if n is None:
        df = df.join(hinted(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))), keys)
    placed = df.withColumn("_blocks", F.ceil(F.col(n or "_n") / block)).withColumn("_i", F.pmod(F.xxhash64("item"), "_blocks"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    met = placed.withColumn("_j", others).select(*keys, F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"), "_i", "item")
    x, y = met.select(*keys, "_lo", "_hi", "_i", F.col("item").alias("x")), met.select(*keys, "_lo", "_hi", F.col("_i").alias("_k"), F.col("item").alias("y"))
    once = (F.col("_i") != F.col("_k")) | (F.col("_lo") == F.col("_hi"))
    return x.join(hinted(y), [*keys, "_lo", "_hi"]).where((F.col("x") < F.col("y")) & once).select(*keys, "x", "y")


def met_with_some(some: DataFrame, df: DataFrame, keys: list[str], n: str, block: int = 500) -> DataFrame:
    """(keys, x, y): every item x of some with every item y of df of its key, both tables (keys, item), met in the key's blocks of about `block` items of df.

    n names a column of both with about the number of df's items of the key.
    """
    blocks = F.ceil(F.col(n) / block)
    x = some.select(*keys, F.col("item").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_b"))
    y = df.select(*keys, F.col("item").alias("y"), F.pmod(F.xxhash64("item"), blocks).alias("_b"))
    return x.join(y, [*keys, "_b"]).select(*keys, "x", "y")


def among(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = 20) -> DataFrame:
    """The rows whose keys wanted holds, and some more: those whose hash falls on the same one of 2^bits bits. What is broadcast are these bits."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(1 << bits)).cast("int")
    place, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63))
    words = wanted.groupBy(place.alias("place")).agg(F.bit_or(mask).alias("mask")).collect()  # 2^(bits - 6) rows at most
    bitmap = [0] * (1 << (bits - 6))
    for r in words:
        bitmap[r["place"]] = r["mask"]
    bitmap = F.broadcast(rows.sparkSession.createDataFrame([(bitmap,)], "_bits array<long>"))
    return rows.join(bitmap, F.get("_bits", place).bitwiseAND(mask) != 0).select(*rows.columns)


def join_sliced(left: DataFrame, right: DataFrame, keys: list[str], slices: int = 64, floor: int = 50_000) -> DataFrame:
    """left joined to right on keys, with the rows of right's hot keys dealt to `slices` tasks and left's rows of these keys sent to all of them."""
    return join_apart(left, right, keys, crowded(right, keys, floor), slices)


def join_apart(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, slices: int = 64) -> DataFrame:
    """join_sliced with the hot keys of right that crowded() found, for several joins to one table."""
    if hot is None:
        return left.join(right, keys)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    one = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[c for c in right.columns if c not in keys]), F.lit(slices))).otherwise(0).cast("int")
    x = left.join(hot, keys, "left").withColumn("_slice", F.explode(every)).drop("_hot")
    y = right.join(hot, keys, "left").withColumn("_slice", one).drop("_hot")
    return x.join(y, [*keys, "_slice"]).drop("_slice")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the place of every row in a total order, counted from 1, sorted in many tasks: a row's place in its sorted partition and the rows of the partitions before."""
    placed = materialise(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for p, n in counts:  # one row for each partition
        offsets.append((p, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p long, _before long"))
    at = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_p", F.shiftright("_id", 33)).join(offsets, "_p").withColumn(name, at).drop("_p", "_id", "_before")
