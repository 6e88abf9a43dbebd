"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all tasks run on this machine (tests), a folder of this session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark, "_knotwork_shared", None)
        if where is None:
            where = tempfile.mkdtemp(prefix="knotwork-")
            spark._knotwork_shared = where
    return where.rstrip("/")


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a
    recomputation, and so that a result used several times is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for a session, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_knotwork_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="knotwork-")) / "knotwork.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._knotwork_shipped = True
    return spark
