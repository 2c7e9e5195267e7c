"""Reading PDF files into a corpus, generating files from table rows, and a data source ``pdf``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
    StringContains, StringEndsWith, StringStartsWith,
)

XREF = "array<struct<section_ix:int,entry_ix:int,obj_num:int,etype:string,offset:bigint,gen:int,stm_num:int,stm_index:int>>"
OBJECTS = (
    "array<struct<obj_num:int,gen:int,kind:string,type_name:string,subtype:string,filters:array<string>,stream_offset:bigint,"
    "stream_raw:binary,stream_decoded:binary,error:string>>"
)
NODES = (
    "array<struct<obj_num:int,gen:int,node_ix:int,parent_ix:int,depth:int,key:string,key_path:string,ord:int,kind:string,n_children:int,"
    "bool_v:boolean,int_v:bigint,real_v:double,str_v:string,ref_num:int,ref_gen:int>>"
)
BACKREFS = "array<struct<obj_num:int,from_num:int,from_gen:int,key_path:string,type_name:string,ord:int>>"
REPAIRS = "array<struct<what:string,obj_num:int,offset:bigint>>"
PARSED = (
    "path string, file_id string, length bigint, version string, binary_marker binary, startxref bigint, xref_type string, linearized boolean, "
    f"error string, xref {XREF}, objects {OBJECTS}, nodes {NODES}, backrefs {BACKREFS}, repairs {REPAIRS}"
)
#: Files, and rows of bytes, are worked on a few at a time, so a task holds the results of only a few.
BATCH = 16
#: Bytes of rows that a task makes files of; a row counts as its text and as much again as the rest of a small file.
TASK_BYTES, ROW_BYTES = 8 << 20, 4 << 10


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of ``BATCH`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def in_one_worker(*steps):
    """Steps of ``mapInArrow``, one fed by the other, as one step: Spark keeps a Python worker for each step of a task, with all that it imports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def _parser(schema):
    from quire.functions.structure import parse_file

    fields = [(f.name, arrow_type(f.dataType)) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [{"path": p, **parse_file(c or b"")} for p, c in zip(part.column("path").to_pylist(), part.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], names=[n for n, _ in fields])

    return run


def parsing() -> tuple:
    """``parse`` as a step and its schema, for files that are at hand in a Python worker (``generate``)."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(PARSED)
    return _parser(schema), schema


def parse(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to one row of nested tables a file; what cannot be read is a row with ``error``."""
    return files.select("path", "content").mapInArrow(*parsing())


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """PDF files of a folder as ``path, modificationTime, length, content``; content is read only if asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def store_list(spark: SparkSession, path: str) -> DataFrame:
    """File names and sizes in case-insensitive order."""
    name = F.element_at(F.split("path", "/"), -1)
    return read_files(spark, path).select(name.alias("filename"), F.col("length").alias("size")).orderBy(F.lower("filename"), "filename")


def store_names(new: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """``new(filename, ...)`` with ``stored_as``: its name, or with the least free ``_1, _2, ...`` where that is taken.

    Rows of one name take their numbers by ``order``; ``stored(filename)`` are the names in use.
    A name that another new row has is not given out.
    """
    split = r"^(.*?)(\.[^.]*)?$"
    name = lambda stem, end, n: F.concat(stem, F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), end)
    rows = new.withColumn("_k", F.row_number().over(Window.partitionBy("filename").orderBy(order)))
    # As many numbers as new rows and stored names of the stem ask for; those not taken are given out in order.
    stem, end = F.regexp_extract("filename", split, 1), F.regexp_extract("filename", split, 2)
    taken = stored.select("filename", F.lit(True).alias("_all")).union(new.select("filename", F.lit(False))).groupBy("filename").agg(F.bool_or("_all").alias("_all"))
    used = taken.select(F.regexp_replace(stem, r"_\d+$", "").alias("_stem"), end.alias("_end")).union(taken.select(stem.alias("_stem"), end.alias("_end"))).groupBy("_stem", "_end").agg(F.count("*").alias("_used"))
    need = new.groupBy("filename").agg(F.count("*").alias("_new")).withColumn("_stem", stem).withColumn("_end", end).join(used, ["_stem", "_end"], "left")
    free = need.select("filename", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_new") + F.coalesce("_used", F.lit(0)))).alias("_n"), "_stem", "_end")
    free = free.withColumn("stored_as", name(F.col("_stem"), F.col("_end"), F.col("_n"))).join(taken.withColumnRenamed("filename", "stored_as"), "stored_as", "left")
    free = free.where(F.col("_all").isNull() | (~F.col("_all") & (F.col("_n") == 0)))
    free = free.withColumn("_k", F.row_number().over(Window.partitionBy("filename").orderBy("_n"))).select("filename", "_k", "stored_as")
    return rows.join(free, ["filename", "_k"]).drop("_k")


def tasks(rows: DataFrame, size: Column) -> int:
    """As many tasks as the bytes of ``rows``, ``size`` each, ask for."""
    total = rows.agg(F.sum(F.coalesce(size, F.lit(0)) + ROW_BYTES)).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def spread(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` dealt out to as many tasks as their bytes in ``column`` ask for, however few files or row groups they came from."""
    return rows.repartition(tasks(rows, F.octet_length(column)))


def tasks_of(docs: DataFrame) -> int:
    """Tasks that ``generate`` deals ``docs`` out to."""
    return tasks(docs, F.octet_length("text"))


def generate(docs: DataFrame, layout: str = "lay1", keep: tuple[str, ...] = (), then: tuple | None = None, tasks: int | None = None) -> DataFrame:
    """A one-page PDF for each row of ``docs(doc_id, text, lang, source)``: ``doc_id, path, length, content``; columns to ``keep`` pass by.

    ``then``, a step of ``mapInArrow`` and its schema, gets the files in the worker that makes them; its rows are returned in their place.
    Rows are dealt out by path, so that a table by path of as many buckets as ``tasks`` (``tasks_of`` by default) has a file a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quire.functions.write import layout as make

        for batch in slices(batches):
            ids, texts, langs, sources = (c.to_pylist() for c in batch.columns[:4])
            files = [make(layout, *x) for x in zip(texts, langs, sources)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([f"{i}.pdf" for i in ids]), pa.array([len(f) for f in files], pa.int64()), pa.array(files, pa.binary()), *batch.columns[4:]],
                names=["doc_id", "path", "length", "content", *keep],
            )

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "lang", "source", *keep)
    more = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in keep)
    step, schema = (run, f"doc_id long, path string, length long, content binary{more}") if then is None else (in_one_worker(run, then[0]), then[1])
    dealt = rows.withColumn("_path", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))).repartition(tasks or tasks_of(rows), "_path").drop("_path")
    return dealt.mapInArrow(step, schema)


class _Files(InputPartition):
    """Files of one task with their sizes."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(len(files))
        self.files = files


FILE_SCHEMA = "path string, file_id string, length bigint, version string, xref_type string, linearized boolean, error string, n_objects int, n_xref int"
OBJECT_SCHEMA = "path string, length bigint, version string, obj_num int, gen int, kind string, type_name string, subtype string, error string"
#: Columns that are known before a file is opened, and those that its first bytes tell.
UNOPENED, UNPARSED = ("path", "length"), ("version",)
HEAD = 1024


def _holds(f: Filter, value) -> bool | None:
    """Whether a pushed filter holds for a value, None where that is unknown, as SQL has it."""
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if isinstance(f, Not):
        inner = _holds(f.child, value)
        return None if inner is None else not inner
    if value is None:
        return None
    if isinstance(f, In):
        return True if value in f.value else None if None in f.value else False
    if f.value is None:
        return None
    return {
        EqualTo: value.__eq__, GreaterThan: value.__gt__, GreaterThanOrEqual: value.__ge__, LessThan: value.__lt__, LessThanOrEqual: value.__le__,
        StringStartsWith: getattr(value, "startswith", None), StringEndsWith: getattr(value, "endswith", None), StringContains: getattr(value, "__contains__", None),
    }[type(f)](f.value)


def _column(f: Filter) -> str | None:
    """The one column that a supported filter is about."""
    if isinstance(f, Not):
        return _column(f.child)
    known = (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
    return f.attribute[0] if isinstance(f, known) and len(f.attribute) == 1 else None


class _Reader(DataSourceReader):
    """Files dealt out by bytes; pushed filters keep files from being opened, read whole, or giving rows."""

    def __init__(self, path: str, table: str, columns: list[str], task_bytes: int):
        self.path, self.table, self.columns, self.task_bytes = path, table, columns, task_bytes
        self.pushed: dict[str, list[Filter]] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = _column(f)
            if name in self.columns:
                self.pushed.setdefault(name, []).append(f)
            else:
                yield f

    def _kept(self, names, row: dict) -> bool:
        return all(_holds(f, row[n]) is True for n in names for f in self.pushed.get(n, ()))

    def partitions(self):
        import glob
        import os

        paths = sorted(glob.glob(os.path.join(self.path, "*.pdf"))) if os.path.isdir(self.path) else [self.path]
        out, held = [], 0
        for p in paths:
            n = os.path.getsize(p)
            if not self._kept(UNOPENED, {"path": p, "length": n}):
                continue
            if not out or held + n > self.task_bytes:
                out.append([])
                held = 0
            out[-1].append((p, n))
            held += n
        return [_Files(x) for x in out] or [_Files([])]

    def read(self, partition):
        from quire.functions.structure import header, parse_file

        rest = [c for c in self.columns if c not in (*UNOPENED, *UNPARSED)]
        for path, length in partition.files:
            with open(path, "rb") as f:
                head = f.read(HEAD)
                at = head.find(b"%PDF-")
                # Where the version stands in the first bytes, a file of another one is not read further.
                if at == 0 and not self._kept(UNPARSED, {"version": header(head)[0]}):
                    continue
                r = parse_file(head + f.read())
            facts = {"path": path, **{k: r[k] for k in ("file_id", "length", "version", "xref_type", "linearized", "error")}, "n_objects": len(r["objects"]), "n_xref": len(r["xref"])}
            rows = [facts] if self.table == "files" else [{**facts, **{k: o[k] for k in ("obj_num", "gen", "kind", "type_name", "subtype", "error")}} for o in r["objects"]]
            for row in rows:
                if self._kept((*UNPARSED, *rest), row):
                    yield tuple(row[c] for c in self.columns)


class PdfSource(DataSource):
    """``spark.read.format("pdf").load(folder)``: PDF files on a local or mounted path.

    Option ``table``: ``files``, one row of facts a file (the default), or
    ``objects``, one row an object.  Option ``taskBytes``: bytes of files that a
    task reads (128 MiB), so that many small files are few tasks.  Filters on
    single columns are pushed: by path and length files are left out before any
    is opened, by version after their first bytes, and all others keep rows
    from leaving the reader.  ``register`` turns on Spark's pushdown into Python sources.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return OBJECT_SCHEMA if self._table() == "objects" else FILE_SCHEMA

    def _table(self) -> str:
        table = self.options.get("table", "files")
        if table not in ("files", "objects"):
            raise ValueError(f"no table {table}: files or objects")
        return table

    def reader(self, schema):
        return _Reader(self.options.get("path"), self._table(), [f.name for f in schema.fields], int(self.options.get("taskBytes", 128 << 20)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(PdfSource)
