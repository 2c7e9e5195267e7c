"""A corpus: parsed files as tables.  Everything else is a DataFrame over these."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import written_by_path
from quire.sources import pdf


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


class Corpus:
    """Tables of parsed files; ``parsed`` has one row a file with its tables nested.

    Nested columns are pruned, so a question that needs no values never ships
    them; of objects the stream bytes are read only for ``streams``.  A corpus that is asked more than once should be saved and reopened:
    parsing is the only step that runs Python over whole files.  Saved by path (``by_path``), its tables are joined without a shuffle.
    """

    def __init__(self, parsed: DataFrame, buckets: int | None = None):
        self.parsed, self.buckets = parsed, buckets

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        # Files are parsed where they are read: their bytes never pass a shuffle.
        return cls(pdf.parse(pdf.read_files(spark, path)))

    @classmethod
    def from_binary(cls, files: DataFrame) -> Corpus:
        return cls(pdf.parse(files))

    def save(self, path: str) -> Corpus:
        self.parsed.write.mode("overwrite").parquet(path)
        return Corpus(self.parsed.sparkSession.read.parquet(path))

    def by_path(self, label: str, buckets: int) -> Corpus:
        """The corpus as a table of ``buckets`` by path; see ``session.written_by_path``."""
        return Corpus(written_by_path(self.parsed, label, buckets), buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Corpus:
        return cls(spark.read.parquet(path))

    def _rows(self, column: str, without: tuple[str, ...] = ()) -> DataFrame:
        fields = [f for f in self.parsed.schema[column].dataType.elementType.names if f not in without]
        # An array of structs is read whole even where only some fields of its items are wanted; one of chosen fields is not.
        items = F.arrays_zip(*[F.col(f"{column}.{f}") for f in fields]) if without else F.col(column)
        return self.parsed.select("file_id", "path", F.explode(items).alias("_r")).select("file_id", "path", *[F.col(f"_r.{f}") for f in fields])

    @cached_property
    def tasks(self) -> int:
        """Tasks for work on bytes, by the sizes of the files: joins leave as few as their shuffled bytes fill, each with hours of work."""
        return pdf.tasks(self.parsed, F.col("length"))

    def dealt(self, rows: DataFrame, *by: str) -> DataFrame:
        """``rows`` of bytes in as many tasks as the corpus's bytes ask for: where they lie, if that is by path."""
        return rows if self.buckets else rows.repartition(self.tasks, *by)

    @cached_property
    def files(self) -> DataFrame:
        return self.parsed.select("file_id", "path", "length", "version", "binary_marker", "startxref", "xref_type", "linearized", "error")

    @cached_property
    def sections(self) -> DataFrame:
        """All entries of all cross-reference sections."""
        return self._rows("xref")

    @cached_property
    def xref(self) -> DataFrame:
        """The entry that counts for each number: that of the newest section, the first within it."""
        return first_of(self.sections, ["file_id", "path", "obj_num"], ["section_ix", "entry_ix"])

    @cached_property
    def objects(self) -> DataFrame:
        return self._rows("objects", ("stream_raw", "stream_decoded"))

    @cached_property
    def streams(self) -> DataFrame:
        """Stream bytes apart from the other facts, so that joins do not move them."""
        return self._rows("objects").where("kind = 'Stream'").select("file_id", "path", "obj_num", "gen", "filters", "stream_offset", "stream_raw", "stream_decoded")

    @cached_property
    def nodes(self) -> DataFrame:
        return self._rows("nodes")

    @cached_property
    def backrefs(self) -> DataFrame:
        return self._rows("backrefs")

    @cached_property
    def repairs(self) -> DataFrame:
        """What was put right: ``index`` rebuilt, ``trailer`` made up, ``entry`` moved, ``length`` of a stream found."""
        return self._rows("repairs")

    def trailer(self) -> DataFrame:
        return self.nodes.where("obj_num = -1 and depth = 1")

    def entry(self, key: str) -> DataFrame:
        """Top-level dictionary entries named ``key``."""
        return self.nodes.where((F.col("depth") == 1) & (F.col("key") == key))
