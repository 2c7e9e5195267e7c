"""Where things lie in a file: sizes, gaps, running offsets, interval containment; and search, sort and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sizes(points: DataFrame, by: list[str], at: str, end: Column | str) -> DataFrame:
    """``points`` with ``size``: the distance to the next one of the group, of the last one to ``end``."""
    w = Window.partitionBy(*by).orderBy(at)
    end = F.col(end) if isinstance(end, str) else end
    return points.withColumn("size", F.coalesce(F.lead(at).over(w), end) - F.col(at))


def object_sizes(c) -> DataFrame:
    """Bytes from each object in use to the next; of the last to the end of the file."""
    rows = c.xref.where("etype = 'in_use'").join(c.files.select("file_id", "path", "length"), ["file_id", "path"])
    return sizes(rows, ["file_id", "path"], "offset", "length")


def export_bounds(c) -> DataFrame:
    """Where each object's bytes end for export: the next object, the index after the last; none in linearized files.

    The object that is the index itself (an xref stream) reaches to ``startxref``.
    """
    rows = c.xref.where("etype = 'in_use'").join(c.files.select("file_id", "path", "length", "startxref", "linearized"), ["file_id", "path"])
    w = Window.partitionBy("file_id", "path").orderBy("offset")
    own = F.col("offset") == F.col("startxref")
    return rows.withColumn("is_index", own).withColumn("end", F.when(~F.col("linearized") & ~own, F.coalesce(F.lead("offset").over(w), F.col("startxref"))))


def running_offset(rows: DataFrame, by: list[str], order: list[str], size: str, start: Column | int = 0) -> DataFrame:
    """``rows`` with ``begin``: what lies before each in its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = start if isinstance(start, Column) else F.lit(start)
    return rows.withColumn("begin", base + F.coalesce(F.sum(size).over(w), F.lit(0)))


def running_total(rows: DataFrame, order: str, size: str, block: int) -> DataFrame:
    """``rows`` with ``begin`` over the whole table, in two levels.

    Totals of blocks of ``order`` are chained first, so no single task sorts the
    rows; only one row for each block meets in one place.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    totals = rows.groupBy("_block").agg(F.sum(size).alias("_total"))
    # ``block`` is chosen so that blocks are few: one row each.
    chain = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_block", F.coalesce(F.sum("_total").over(chain), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(base, "_block").withColumn("begin", F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return out.drop("_block", "_base")


def gaps(intervals: DataFrame, by: list[str], begin: str, end: str) -> DataFrame:
    """Stretches between intervals of a group that none of them covers: ``by, gap_begin, gap_end``."""
    w = Window.partitionBy(*by).orderBy(begin, end).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("_end", F.max(end).over(w)).where(F.col(begin) > F.col("_end")).select(*by, F.col("_end").alias("gap_begin"), F.col(begin).alias("gap_end"))


def strip(intervals: DataFrame, by: list[str], begin: str, end: str, total: str, label: str) -> DataFrame:
    """All of a file as segments ``by, begin, end, label, is_gap``: the intervals, and gap rows before, between and after them.

    ``total`` is the file's length, a column of ``intervals``.
    """
    own = intervals.select(*by, F.col(begin).cast("long").alias("begin"), F.col(end).cast("long").alias("end"), F.col(label).cast("string").alias("label"), F.lit(False).alias("is_gap"))
    edges = intervals.groupBy(*by).agg(F.min(begin).alias("low"), F.max(end).alias("top"), F.max(total).alias("whole"))
    gap = lambda rows, a, b: rows.select(*by, F.col(a).cast("long"), F.col(b).cast("long"), F.lit("gap"), F.lit(True))
    before = gap(edges.where("low > 0").withColumn("zero", F.lit(0)), "zero", "low")
    after = gap(edges.where("top < whole"), "top", "whole")
    return own.union(before).union(gap(gaps(intervals, by, begin, end), "gap_begin", "gap_end")).union(after)


def xref_strip(c) -> DataFrame:
    """The file as its header, its objects in use and what follows them."""
    rows = object_sizes(c).where("size > 0").withColumn("_end", F.col("offset") + F.col("size"))
    return strip(rows, ["file_id", "path"], "offset", "_end", "length", "obj_num")


def compression_ratio(raw: Column, decoded: Column) -> Column:
    """Share that compression saves; null for nothing."""
    return F.when(decoded > 0, 1 - raw / decoded)


def range_join(points: DataFrame, intervals: DataFrame, at: str, begin: str, end: str, bucket: int, by: list[str] = ()) -> DataFrame:
    """Pairs with ``begin <= at < end``, as an equi-join on buckets of width ``bucket``.

    An interval is repeated for each bucket it touches; choose ``bucket`` near the
    usual interval length.  Empty intervals hold nothing.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / bucket))
    i = intervals.where(F.col(begin) < F.col(end))
    i = i.withColumn("_b", F.explode(F.sequence(F.floor(F.col(begin) / bucket), F.floor((F.col(end) - 1) / bucket))))
    return p.join(i, [*by, "_b"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_b")


def section_offsets(pages: DataFrame) -> DataFrame:
    """Begin of each page's section in a linearized file.

    ``pages`` has one row a page with ``page, page_length, n_dicts, dict_offset``
    and the file's ``first_page_offset, hint_offset, hint_length, end_of_first_page``.
    The first page is moved by the hint stream if that lies before it; the others
    lie where their page dictionaries do if all are known, else one after another.
    """
    w = Window.partitionBy("file_id", "path")
    before = w.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("first_page_offset") + F.when((F.col("hint_offset") > 0) & (F.col("first_page_offset") >= F.col("hint_offset")), F.col("hint_length")).otherwise(0)
    cumulative = F.col("end_of_first_page") + F.coalesce(F.sum(F.when(F.col("page") > 0, F.col("page_length")).otherwise(0)).over(before), F.lit(0))
    known = F.count("dict_offset").over(w) == F.count("*").over(w)
    return pages.withColumn("section_offset", F.when(F.col("page") == 0, first).when(known, F.col("dict_offset")).otherwise(cumulative))


def effective_offsets(c) -> DataFrame:
    """Offsets of objects; those in object streams lie where their host does."""
    used = c.xref.where("etype = 'in_use'").select("file_id", "path", "obj_num", "offset")
    host = used.select("file_id", "path", F.col("obj_num").alias("stm_num"), F.col("offset").alias("host_offset"))
    packed = c.xref.where("etype = 'compressed'").join(host, ["file_id", "path", "stm_num"]).select("file_id", "path", "obj_num", F.col("host_offset").alias("offset"))
    return used.union(packed)


def objects_by_section(c, sections: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """Object numbers within each page section ``(file_id, path, page, section_offset, page_length)``."""
    s = sections.withColumn("section_end", F.col("section_offset") + F.col("page_length"))
    found = range_join(effective_offsets(c), s, "offset", "section_offset", "section_end", bucket, ["file_id", "path"])
    return found.groupBy("file_id", "path", "page").agg(F.array_sort(F.collect_list("obj_num")).alias("obj_nums"))


def absent(ids: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Numbers from ``low`` below ``high`` that ``ids`` lacks."""
    return ids.sparkSession.range(low, high).withColumnRenamed("id", column).join(ids.select(F.col(column).cast("long")), column, "left_anti")


def coverage(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits))


def grid_width(n: Column) -> Column:
    """Power of two of at least the square root of ``n``, from 16 to 256."""
    return F.when(n <= 256, 16).when(n <= 1024, 32).when(n <= 4096, 64).when(n <= 16384, 128).otherwise(256)


def page_of(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` from 0 of the rows in order."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def sort_entries(rows: DataFrame, key: str, descending: bool = False, etype: str | None = None) -> DataFrame:
    """Index entries of a type, sorted; missing sizes count as 0, kinds sort as people expect, ties by number."""
    if etype:
        rows = rows.where(F.col("etype") == etype)
    col = F.coalesce(F.col(key), F.lit(0)) if key == "size" else F.collate(F.col(key), "UNICODE") if key == "kind" else F.col(key)
    return rows.orderBy(col.desc() if descending else col.asc(), "obj_num")


def search_map(rows: DataFrame, text: str) -> DataFrame:
    """Character-map rows whose source holds a hexadecimal text, or that give this character or code point."""
    return rows.where(F.contains(F.upper("src_hex"), F.lit(text.upper())) | (F.col("char") == text) | (F.col("code_point").cast("string") == text))


def search_number(rows: DataFrame, column: str, text: str) -> DataFrame:
    return rows.where(F.contains(F.col(column).cast("string"), F.lit(text)))


def search_glyphs(rows: DataFrame, text: str, name: str = "glyph", index: str = "gid") -> DataFrame:
    """Glyphs whose name (case apart) or index holds a text; all of them for an empty one."""
    return rows.where(F.contains(F.lower(name), F.lit(text.lower())) | F.contains(F.col(index).cast("string"), F.lit(text))) if text else rows


def byte_label(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / (1 << 20)))
