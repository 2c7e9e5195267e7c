"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``free`` after large shuffles.

    Cuts the lineage: a lost executor costs at most the tasks since this point,
    and the files outlive every executor.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    if free:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark deletes them when the driver collects the plans that made them, which a
    driver with little to do may put off until disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        files = df.inputFiles()
        if not files:
            continue
        folder = files[0].rsplit("/", 1)[0]
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def slices(spark: SparkSession, least: int = 12) -> int:
    """Partitions for shuffles that are planned by hand; follows the session's own setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
