"""Streams: documents that arrive, and accesses that add up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from knotwork.functions.text import content_hash
from knotwork.operators.access import access_stats, accesses_by_window
from knotwork.operators.graph import unseen
from knotwork.session import materialise


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_unseen(
    stream: DataFrame, store: str, text: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, scope: tuple[str, ...] = (), parts: int = 64
) -> StreamingQuery:
    """Appends the rows whose text the store does not hold yet, batch by batch until the present input is used up.

    The store keeps the hash of every text in `text_hash` and lies in `parts`
    folders by it (`hash_part`), so that a batch is compared by anti-join with
    the stored hashes of the parts that it falls into, and no text is hashed
    again. A batch that is run again after a failure finds its rows in the store
    and adds nothing. Texts are compared within the columns of scope. `then`
    gets what was added, to build edges for it.
    """
    part = F.pmod(F.xxhash64("text_hash"), F.lit(parts)).cast("int")

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = materialise(batch.withColumn("text_hash", content_hash(F.col(text))).withColumn("hash_part", part), "batch")
        try:
            known = spark.read.parquet(store)
        except AnalysisException:  # nothing is stored yet
            known = batch.limit(0)
        met = [r[0] for r in batch.select("hash_part").distinct().collect()]
        fresh = materialise(unseen(batch, known.where(F.col("hash_part").isin(met)), text, scope, "text_hash"), "fresh")
        fresh.write.mode("append").partitionBy("hash_part").parquet(store)
        if then:
            then(fresh.drop("text_hash", "hash_part"), number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_texts(stream: DataFrame, text: str, at: str, late: str) -> DataFrame:
    """A stream's rows with each text once within the time that rows may be late."""
    return stream.withColumn("_hash", content_hash(F.col(text))).withWatermark(at, late).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def running_access_stats(stream: DataFrame, node: str, at: str, store: str, checkpoint: str) -> StreamingQuery:
    """Appends to a table, batch by batch, the last access and number of accesses so far of every node that the batch touched.

    The newest state of a node is its row with the highest batch_no (see
    current_access_stats); nothing is held on the driver, and a batch that is run
    again writes the same rows under the same number.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return access_stats(stream, node, at).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_access_stats(spark: SparkSession, store: str, node: str) -> DataFrame:
    """(node, last_accessed_at, access_count): the newest state of every node that running_access_stats wrote."""
    rows = spark.read.parquet(f"{store}/batch=*")
    return rows.groupBy(node).agg(F.max_by(F.struct("last_accessed_at", "access_count"), "batch_no").alias("s")).select(node, "s.*")


def windowed_accesses(stream: DataFrame, at: str, kind: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Accesses by window of a stream, closed once rows later than `late` cannot come any more."""
    return accesses_by_window(stream.withWatermark(at, late), at, kind, width, slide)
