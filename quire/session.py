"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="quire-"))
    return _local[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: work done once, with no lineage to repeat."""
    path = f"{shared_dir(df.sparkSession)}/quire/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by_path(df: DataFrame, label: str, buckets: int) -> DataFrame:
    """``written``, dealt out by ``path``: tables of as many buckets are joined and grouped by path, and by more than that, without a shuffle.

    Rows are not moved: each task writes what it has, so ``df`` should come from
    tasks that hold its paths whole, as those of such a table and of ``pdf.generate`` do; else it becomes more files, of the same rows.
    """
    spark = df.sparkSession
    name = f"quire_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, "path").option("path", f"{shared_dir(spark)}/quire/{name}").saveAsTable(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Delete a ``written`` table that no later plan reads."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_STATIC, _MEASURED, _GIVEN = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.quire.givenThresholds"
#: How tables that lie by path are joined, and what the session had before.  A union of such tables does not lie by path:
#: where Spark plans as if it did, but runs it otherwise, groups come out torn.
_BY_PATH = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.unionOutputPartitioning": "false"}
_GIVEN_BY_PATH = "spark.quire.given."


def joins_by_measure(spark: SparkSession) -> None:
    """Let joins broadcast only what a shuffle has found to be small.

    Parsed files that resemble each other compress a hundredfold, and a few
    columns of them count as a few hundredths of that: by its files' size a
    table of gigabytes passes for one of megabytes and would be broadcast through the driver.
    """
    if spark.conf.get(_GIVEN, None) is None:
        static = spark.conf.get(_STATIC)
        spark.conf.set(_GIVEN, f"{static} {spark.conf.get(_MEASURED, None) or ''}")
        if not spark.conf.get(_MEASURED, None):
            spark.conf.set(_MEASURED, static)
        spark.conf.set(_STATIC, "-1")
        # Tables that lie by path are joined by objects of a path where they are.
        for name, value in _BY_PATH.items():
            spark.conf.set(_GIVEN_BY_PATH + name, spark.conf.get(name))
            spark.conf.set(name, value)


def joins_as_given(spark: SparkSession) -> None:
    """Undo ``joins_by_measure``: the session's own settings."""
    given = spark.conf.get(_GIVEN, None)
    if given is not None:
        static, measured = given.split(" ")
        spark.conf.set(_STATIC, static)
        spark.conf.set(_MEASURED, measured) if measured else spark.conf.unset(_MEASURED)
        for name in _BY_PATH:
            spark.conf.set(name, spark.conf.get(_GIVEN_BY_PATH + name))
        spark.conf.unset(_GIVEN)


def ship(spark: SparkSession) -> None:
    """Give this package's source to the Python workers, once per application.

    The driver serves the archive to the executors, so they need not share a
    folder with it; where the package is installed on them this changes nothing.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
