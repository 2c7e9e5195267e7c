"""Incremental ingest: new files, or rows with file content, parsed as they arrive into the same tables as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import pdf


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_per_trigger: int = 256) -> DataFrame:
    """A stream of ``path, modificationTime, length, content`` of files that appear in a folder."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )


def parsed_stream(files: DataFrame) -> DataFrame:
    """Parsed files of a stream; parsing keeps no state."""
    return pdf.parse(files)


def ingest(files: DataFrame, table: str, checkpoint: str) -> None:
    """Parse all that is there, append it to the Parquet folder ``table``, and stop; a restart goes on where it stopped."""
    query = parsed_stream(files).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start()
    query.awaitTermination()


def operator_feed(ops: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Counts of operators by category in event-time windows, late rows dropped after ``delay``.

    ``ops`` is a stream with ``seen timestamp, category``.
    """
    return ops.withWatermark("seen", delay).groupBy(F.window("seen", window), "category").count()
