"""Linking exploded files as relations: one row an object, offsets by prefix sums over segments.

A file with millions of objects is many rows in many tasks here: objects have
their new bytes, segments of the file their sums, and the begin of an object is
what lies before its segment and before it within.  The index is made of pieces
of a bounded number of entries.  Python sees only objects that an edit changed,
members of the object streams around them, and the few bytes that frame a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

from quire.sources.pdf import slices

from . import pdfx

#: Bytes of a source file whose objects are summed in one group, and entries in a piece of an index.
SEGMENT, ENTRIES = 1 << 24, 1 << 14


def _per_row(rows: DataFrame, columns: list[str], work, out: str) -> DataFrame:
    """``rows`` with a binary column ``out`` of ``work(*columns)``; the other columns pass by."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, {out} binary"
    names = list(rows.columns)
    at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = pa.array([work(*v) for v in zip(*(b.column(i).to_pylist() for i in at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*names, out])

    return rows.mapInArrow(run, schema)


def _value_body(source: bytes, payload: bytes | None, has_stream: bool, num: int, gen: int, member: bool) -> bytes:
    """An object's bytes from its JSON and payload; of a member of an object stream its value alone."""
    from quire.functions import pdfx as P
    from quire.functions import write as W

    row = {"num": num, "gen": gen, "has_stream": has_stream, "resource_file": "payload"}
    v = P._value(row, {f"{P._stem(row)}.pdfjson": source, "payload": payload or b""})
    return W.body(v) if member else W.indirect(num, v, gen)


def _packed(members: list[dict], num: int, gen: int) -> bytes:
    from quire.functions import write as W

    return W.indirect(num, W.packed_stream([m["num"] for m in members], [m["body"] for m in members]), gen)


def _framed(kind: str, trailer: bytes, size: int, at: int, own: int) -> tuple[bytes, bytes]:
    """What stands before and behind the entries of an index."""
    import json

    from quire.functions import pdfx as P
    from quire.functions import write as W
    from quire.functions.lexer import Value

    kept = {k: v for k, v in P.from_json(json.loads(trailer)).data.items() if k in ("Root", "Info", "ID")}
    end = b"\nstartxref\n%d\n%%%%EOF\n" % at
    if kind == "table":
        return b"xref\n0 %d\n" % size, b"trailer\n" + W.body(Value("Dictionary", kept | {"Size": W.wrap(size)})) + end
    entries = {"Type": W.wrap("XRef"), "Size": W.wrap(size), "W": W.wrap([1, 4, 2]), **kept, "Length": W.wrap(7 * size)}
    return b"%d 0 obj\n" % own + W.body(Value("Dictionary", entries)) + b"\nstream\n", b"\nendstream\nendobj" + end


def _named(exploded: DataFrame, name: str, alias: str) -> DataFrame:
    return exploded.where(F.col("name") == name).select("path", F.col("data").alias(alias))


def object_parts(manifest: DataFrame, exploded: DataFrame) -> DataFrame:
    """``path, num, gen, byte_offset, changed, data`` of the objects of each file in their new form, those in object streams within their hosts.

    ``changed`` tells whether anything in the file is; then its old index streams are left out.
    """
    rows = pdfx.changes(manifest, exploded).where("status <> 'added'")
    rows = written(rows.select("path", "num", "gen", "byte_offset", "pdf_type", "has_stream", "resource_file", "in_objstm", "objstm_host", "objstm_index", "modified"), "relink-rows")
    edited = rows.groupBy("path").agg(F.bool_or("modified").alias("changed"))
    repack = rows.where("in_objstm and modified").select("path", F.col("objstm_host").alias("host")).distinct()
    stem = F.format_string("objects/%05d_%d", "num", "gen")
    # Objects to write anew: changed ones, and all members of a stream in which one is.
    member = rows.where("in_objstm").join(repack, (rows.path == repack.path) & (rows.objstm_host == repack.host), "left_semi")
    anew = rows.where("modified and not in_objstm").unionByName(member)
    source = exploded.select("path", F.col("name").alias("source_name"), F.col("data").alias("source"))
    payload = exploded.select("path", F.col("name").alias("payload_name"), F.col("data").alias("payload"))
    anew = anew.withColumn("source_name", F.concat(stem, F.lit(".pdfjson"))).withColumn("payload_name", F.when(F.col("has_stream"), F.coalesce("resource_file", F.concat(stem, F.lit(".pdfs")))))
    anew = anew.join(source, ["path", "source_name"]).join(payload, ["path", "payload_name"], "left").select("path", "num", "gen", "in_objstm", "objstm_host", "objstm_index", "has_stream", "source", "payload")
    made = _per_row(anew, ["source", "payload", "has_stream", "num", "gen", "in_objstm"], _value_body, "body").drop("source", "payload")
    made = written(made, "relink-made")
    hosts = made.where("in_objstm").groupBy("path", F.col("objstm_host").alias("num")).agg(F.array_sort(F.collect_list(F.struct("objstm_index", "num", "body"))).alias("members"))
    hosts = hosts.join(rows.select("path", "num", "gen"), ["path", "num"])
    packed = _per_row(hosts, ["members", "num", "gen"], _packed, "body").select("path", "num", "body")
    new = made.where("not in_objstm").select("path", "num", "body").union(packed)
    old = exploded.select("path", F.col("name").alias("old_name"), F.col("data").alias("old"))
    direct = rows.where("not in_objstm").join(edited, "path").where("not (changed and coalesce(pdf_type, '') = 'XRef')").withColumn("old_name", F.concat(stem, F.lit(".pdfo")))
    direct = direct.join(old, ["path", "old_name"], "left").join(new, ["path", "num"], "left")
    return direct.select("path", "num", "gen", "byte_offset", "changed", F.coalesce("body", "old").alias("data"))


def placed(parts: DataFrame, headers: DataFrame) -> DataFrame:
    """``object_parts`` with ``at``, the place of each object; ``headers(path, header)`` come before them."""
    size = F.octet_length("data").cast("long")
    rows = parts.withColumn("segment", F.floor(F.col("byte_offset") / SEGMENT)).withColumn("n", size)
    sums = rows.groupBy("path", "segment").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("path").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("path", "segment", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("path", "segment").orderBy("byte_offset", "num").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["path", "segment"]).join(headers.select("path", F.octet_length("header").alias("first")), "path")
    return rows.select("path", "num", "gen", "changed", "data", "n", (F.col("first") + F.col("base") + F.col("inside")).alias("at"))


def _entry(kind: Column) -> Column:
    """An entry of an index as text (tables) or hexadecimal (streams)."""
    number = lambda v, w: F.lpad(F.hex(v.cast("long")), w, "0")
    digits = lambda v, w: F.lpad(v.cast("string"), w, "0")
    table = F.when(F.col("num") == 0, "0000000000 65535 f\r\n").when(F.col("at").isNotNull(), F.concat(digits(F.col("at"), 10), F.lit(" "), digits(F.col("gen"), 5), F.lit(" n\r\n"))).otherwise("0000000000 00000 f\r\n")
    stream = (
        F.when(F.col("num") == 0, "0000000000FFFF").when(F.col("at").isNotNull(), F.concat(F.lit("01"), number(F.col("at"), 8), number(F.col("gen"), 4)))
        .when(F.col("host").isNotNull(), F.concat(F.lit("02"), number(F.col("host"), 8), number(F.col("place"), 4))).otherwise("00000000000000")
    )
    return F.when(kind == "table", table).otherwise(stream)


def parts(manifest: DataFrame, exploded: DataFrame) -> DataFrame:
    """``path, section, at, data``: files in pieces; put in the order of ``section, at`` they are the files.

    Files without a change end as they did, byte for byte; others have a new
    index of the kind that they had, streams without a filter.
    """
    from quire.functions.pdfx import unescape_header

    names = _per_row(_named(exploded, "header.txt", "raw"), ["raw"], lambda b: unescape_header(b.decode("latin-1").removesuffix("\n")), "header").select("path", "header")
    names = written(names, "relink-headers")
    rows = written(placed(object_parts(manifest, exploded), names), "relink-placed")
    tail = exploded.where("name in ('xref_raw.bin', 'eof_tail.bin')").groupBy("path").agg(F.max_by("data", "name").alias("data"))
    same = rows.where("not changed").select("path").distinct()
    facts = manifest.groupBy("path").agg(
        F.max("num").alias("top"), F.max(F.when(F.coalesce("pdf_type", F.lit("")) == "XRef", F.col("num"))).alias("own"), F.min(F.when(F.coalesce("pdf_type", F.lit("")) == "XRef", F.col("num"))).alias("least_own"))
    changed = rows.where("changed").groupBy("path").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    facts = changed.join(facts, "path").withColumn("kind", F.when(F.col("own").isNull(), "table").otherwise("stream"))
    facts = facts.withColumn("size", F.col("top") + 1)
    whole = facts.join(_named(exploded, "trailer.json", "trailer"), "path").select("path", "kind", "trailer", "size", F.col("end").alias("place"), F.coalesce("least_own", F.lit(0)).alias("own"))
    before = _per_row(whole, ["kind", "trailer", "size", "place", "own"], lambda *v: _framed(*v)[0], "data").select("path", F.lit(2).alias("section"), F.lit(0).cast("long").alias("at"), "data")
    behind = _per_row(whole, ["kind", "trailer", "size", "place", "own"], lambda *v: _framed(*v)[1], "data").select("path", F.lit(4).alias("section"), F.lit(0).cast("long").alias("at"), "data")
    # Every number below the size has an entry; pieces first, so that no row makes more than a piece's numbers.
    piece = facts.select("path", "kind", "size", "end", "least_own", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / ENTRIES))).alias("piece"))
    low = F.col("piece") * ENTRIES
    numbers = piece.select("path", "kind", "end", "least_own", "piece", F.explode(F.sequence(low, F.least(low + ENTRIES, F.col("size").cast("long")) - 1)).alias("num")).withColumn("num", F.col("num").cast("int"))
    host = manifest.where("in_objstm").select("path", "num", F.col("objstm_host").alias("host"), F.row_number().over(Window.partitionBy("path", "objstm_host").orderBy("objstm_index")).alias("k"))
    entries = numbers.join(rows.select("path", "num", "gen", "at"), ["path", "num"], "left").join(host.select("path", "num", "host", (F.col("k") - 1).alias("place")), ["path", "num"], "left")
    own = F.col("num").eqNullSafe(F.col("least_own"))
    entries = entries.withColumn("at", F.when(own, F.col("end")).otherwise(F.col("at"))).withColumn("gen", F.when(own, 0).otherwise(F.col("gen")))
    index = entries.groupBy("path", "kind", "piece").agg(F.array_sort(F.collect_list(F.struct("num", _entry(F.col("kind")).alias("e")))).alias("es"))
    joined = F.array_join(F.transform("es", lambda x: x["e"]), "")
    index = index.select("path", F.lit(3).alias("section"), F.col("piece").alias("at"), F.when(F.col("kind") == "table", F.encode(joined, "ISO-8859-1")).otherwise(F.unhex(joined)).alias("data"))
    heads = names.select("path", F.lit(0).alias("section"), F.lit(0).cast("long").alias("at"), F.col("header").alias("data"))
    objects = rows.select("path", F.lit(1).alias("section"), "at", "data")
    ends = tail.join(same, "path", "left_semi").select("path", F.lit(4).alias("section"), F.lit(0).cast("long").alias("at"), "data")
    return heads.unionByName(objects).unionByName(before).unionByName(index).unionByName(behind).unionByName(ends)


def assemble(pieces: DataFrame) -> DataFrame:
    """``path, content`` of files that fit a row; larger ones are written from their ordered pieces."""
    rows = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("section", "at", "data"))).alias("p"))
    return rows.select("path", F.encode(F.array_join(F.transform("p", lambda x: F.decode(x["data"], "ISO-8859-1")), ""), "ISO-8859-1").alias("content"))


def link(manifest: DataFrame, exploded: DataFrame) -> DataFrame:
    return assemble(parts(manifest, exploded))
