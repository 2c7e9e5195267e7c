"""Content streams: operators, counts, checks, text positions; and what bytes look like."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.content import CATEGORIES, COLORS, DESCRIPTIONS, LABELS, PROBE_OPS

from .corpus import Corpus

KEY = ["file_id", "path", "obj_num"]
OPS = "array<struct<op_ix:int,op:string,category:string,summary:string,operands:array<struct<type:string,value:string>>>>"
RUNS = "array<struct<op_ix:int,x:double,y:double,font:string,size:double,render_mode:int,text:string,note:string>>"
PLACES = "array<struct<op_ix:int,name:string,width:double,height:double,flipped:boolean>>"


def _mapped(rows: DataFrame, work, schema: str, *columns: str) -> DataFrame:
    """``KEY``, an array column ``_r`` of ``work(*columns)``, and ``error`` where that fails; a null first column gives no rows."""
    from pyspark.sql.types import _parse_datatype_string

    from quire.sources.pdf import arrow_type, slices

    kind = arrow_type(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out, errors = [], []
            for values in zip(*(x.to_pylist() for x in b.columns[3:])):
                found, error = [], None
                try:
                    found = work(*values) if values[0] is not None else []
                except Exception as e:  # damaged bytes can fail in any reader; the row says so
                    error = f"{type(e).__name__}: {e}"
                out.append(found)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, kind), pa.array(errors, pa.string())], names=[*KEY, "_r", "error"])

    return rows.select(*KEY, *(columns or ("stream_decoded",))).mapInArrow(run, f"file_id string, path string, obj_num int, _r {schema}, error string")


def content_bytes(c: Corpus) -> DataFrame:
    """Decoded content of every page: its streams in order, joined by a newline.  ``obj_num`` is the page."""
    direct = c.nodes.where("kind = 'Reference' and (key_path = 'Contents' or key_path rlike '^Contents\\\\.\\\\[')")
    direct = direct.select("file_id", "path", F.col("obj_num").alias("page"), F.col("ref_num").alias("obj_num"), F.array(F.when(F.col("key_path") == "Contents", 0).otherwise(F.col("ord"))).alias("at"))
    pages = c.objects.where("type_name = 'Page'").select("file_id", "path", F.col("obj_num").alias("page"))
    direct = direct.join(pages, ["file_id", "path", "page"], "left_semi")
    items = c.nodes.where("depth = 1 and kind = 'Reference' and key rlike '^\\\\['").select(*KEY, "ord", F.col("ref_num").alias("part"))
    through = direct.join(items, KEY).select("file_id", "path", "page", F.col("part").alias("obj_num"), F.array_append("at", F.col("ord")).alias("at"))
    parts = direct.unionByName(through).join(c.streams.select(*KEY, "stream_decoded"), KEY)
    whole = c.dealt(parts, "file_id", "path", "page").groupBy("file_id", "path", "page").agg(F.array_sort(F.collect_list(F.struct("at", "stream_decoded"))).alias("p"))
    # Latin-1 has a character for each byte, so a join of texts is one of bytes.
    texts = F.transform("p", lambda x: F.decode(x["stream_decoded"], "ISO-8859-1"))
    joined = F.when(~F.exists("p", lambda x: x["stream_decoded"].isNull()), F.encode(F.array_join(texts, "\n"), "ISO-8859-1"))
    return whole.select("file_id", "path", F.col("page").alias("obj_num"), joined.alias("stream_decoded"))


def content_ops(pages: DataFrame) -> DataFrame:
    """One row an operator of ``content_bytes``."""
    from quire.functions.content import operators

    return _mapped(pages, operators, OPS).select(*KEY, F.inline("_r"))


def content_errors(pages: DataFrame) -> DataFrame:
    """Pages whose content cannot be read, with the reason."""
    from quire.functions.content import operators

    return _mapped(pages, operators, OPS).where("error is not null").select(*KEY, "error")


def _named(column: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column]


def described(ops: DataFrame) -> DataFrame:
    """``ops`` with ``description`` (empty for unknown operators), and the ``label`` and ``color`` of their category."""
    return ops.select("*", F.coalesce(_named(F.col("op"), DESCRIPTIONS), F.lit("")).alias("description"), _named(F.col("category"), LABELS).alias("label"), _named(F.col("category"), COLORS).alias("color"))


def category_table(spark) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, category_ix int")


def category_counts(ops: DataFrame) -> DataFrame:
    """Operators by category in display order.  The category table has 13 rows."""
    counts = ops.groupBy(*KEY, "category").agg(F.count("*").alias("n_ops"))
    return counts.join(F.broadcast(category_table(ops.sparkSession)), "category")


def _read_font(f: dict) -> dict:
    """A font of ``formats.page_fonts`` for the text machine: its ToUnicode map counts before its encoding."""
    from quire.functions.codes import Codes
    from quire.functions.formats import encoding, glyph_char

    own = {} if f["code_bytes"] > 1 else encoding(f["encoding"]) | {k: glyph_char(g) for k, g in f["differences"] or []}
    codes = None
    if f["code_bytes"] > 1 and not f["unknown_map"]:
        values = lambda rows, *names: [tuple(r[n] for n in names) for r in rows]
        has = f["code_map"] or {"spaces": None, "cids": None}
        codes = Codes(values(has["spaces"] or [], "n", "low", "high"), None if has["cids"] is None else values(has["cids"], "n", "low", "high", "cid"))
    return {"widths": dict(f["widths"] or []), "default_width": f["default_width"], "cmap": own | dict(f["texts"] or []) | dict(f["wide_texts"] or []), "code_bytes": f["code_bytes"], "codes": codes, "unknown": f["unknown_map"]}


def text_runs(pages: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """Position and state of every shown string.

    With ``fonts`` (``formats.page_fonts``) codes are read and measured by the
    fonts of the page; without it they are Latin-1 and 500 wide.
    """
    from quire.functions.content import operations, text_runs

    if fonts is None:
        return _mapped(pages, lambda raw: text_runs(operations(raw)), RUNS).select(*KEY, F.inline("_r"))

    def work(raw, named):
        return text_runs(operations(raw), fonts={f["name"]: _read_font(f) for f in named or []})

    return _mapped(pages.join(fonts, KEY, "left"), work, RUNS, "stream_decoded", "fonts").select(*KEY, F.inline("_r"))


def path_counts(ops: DataFrame) -> DataFrame:
    """Path operators of each stream by what they do."""
    kinds = {"moves": ["m"], "lines": ["l"], "curves": ["c", "v", "y"], "rectangles": ["re"], "closes": ["h"], "clips": ["W", "W*"]}
    kinds |= {"strokes": ["S", "s", "B", "B*", "b", "b*"], "fills": ["f", "F", "f*", "B", "B*", "b", "b*"]}
    return ops.where("category in ('path', 'clip')").groupBy(*KEY).agg(*[F.count_if(F.col("op").isin(v)).alias(f"n_{k}") for k, v in kinds.items()])


def image_placements(pages: DataFrame) -> DataFrame:
    from quire.functions.content import image_placements, operations

    return _mapped(pages, lambda raw: image_placements(operations(raw)), PLACES).select(*KEY, F.inline("_r"))


def has_invisible_text(ops: DataFrame) -> DataFrame:
    """Streams that set text rendering mode 3."""
    return ops.groupBy(*KEY).agg(F.max((F.col("op") == "Tr") & F.exists("operands", lambda o: o["value"] == "3")).alias("invisible"))


def first_operators(ops: DataFrame, n: int) -> DataFrame:
    return ops.where(F.col("op_ix") < n)


def _latin(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def is_binary(raw: Column) -> Column:
    """More than 15 % of the first 512 bytes are not printable."""
    head = _latin(F.substring(raw, 1, 512))
    return F.length(F.regexp_replace(head, r"[\t\n\r\x20-\x7e]", "")) > 0.15 * F.length(head)


def is_content(raw: Column) -> Column:
    """Three of the words in the first 400 bytes are content operators."""
    words = F.split(F.trim(F.regexp_replace(_latin(F.substring(raw, 1, 400)), r"\s+", " ")), " ")
    return F.size(F.filter(words, lambda w: w.isin(PROBE_OPS))) >= 3


def printable(raw: Column) -> Column:
    """Latin-1 text without carriage returns, other controls as full stops."""
    return F.regexp_replace(F.regexp_replace(_latin(raw), "\r", ""), r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", ".")


def hex_dump(raw: Column, limit: int = 65536) -> Column:
    """Lines of offset, 16 bytes in hexadecimal, and their printable form."""
    n = F.ceil(F.least(F.octet_length(raw), F.lit(limit)) / 16).cast("int")

    def line(i: Column) -> Column:
        part = F.substring(F.substring(raw, 1, limit), i * 16 + 1, F.lit(16))
        return F.concat(
            F.lpad(F.lower(F.hex(i * 16)), 8, "0"), F.lit("  "), F.rpad(F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 ")), 47, " "), F.lit("  "),
            F.regexp_replace(_latin(part), r"[^\x20-\x7e]", "."),
        )

    return F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), line), "\n")


def dump_lines(raw: Column, start: Column, size: Column) -> Column:
    """Lines of a part of ``raw``: address and up to 16 bytes, in upper-case hexadecimal."""

    def line(i: Column) -> Column:
        part = F.substring(raw, (start + i * 16 + 1).cast("int"), F.least(F.lit(16), size - i * 16).cast("int"))
        address = F.hex(start + i * 16)
        return F.concat(F.lpad(address, F.greatest(F.lit(4), F.length(address)), F.lit("0")), F.lit(": "), F.trim(F.regexp_replace(F.hex(part), "(..)", "$1 ")))

    lines = F.ceil(size / 16).cast("int")
    return F.transform(F.when(lines > 0, F.sequence(F.lit(0), lines - 1)).otherwise(F.array().cast("array<int>")), line)


def annotated_dump(sections: DataFrame, streams: DataFrame, raw: str = "stream_decoded", limit: int = 65536) -> DataFrame:
    """``dump``: the bytes of each stream by its sections ``KEY, label, offset, size``, at most ``limit`` of them shown.

    Sections come in order of their offsets; what the limit cuts is told with its size.  Each
    section is a row until its lines are text, so only the shown bytes of a stream meet.
    """
    before = Window.partitionBy(*KEY).orderBy("offset", "label").rowsBetween(Window.unboundedPreceding, -1)
    rows = sections.withColumn("left", F.greatest(F.lit(0), limit - F.coalesce(F.sum("size").over(before), F.lit(0)))).withColumn("shown", F.least("size", "left"))
    word = lambda v: F.concat(F.lit("0x"), F.lpad(F.hex(v), F.greatest(F.lit(4), F.length(F.hex(v))), F.lit("0")))
    head = F.concat(F.lit("=== "), "label", F.lit(" ===\n    "), word(F.col("offset")), F.lit(" – "), word(F.col("offset") + F.col("size") - 1), F.lit("  ("), F.col("size").cast("string"), F.lit(" bytes)"))
    rest = F.when(F.col("left") == 0, F.concat(F.lit("     … "), F.col("size").cast("string"), F.lit(" bytes (64K global limit reached) …"))).when(
        F.col("shown") < F.col("size"), F.concat(F.lit("     … "), (F.col("size") - F.col("shown")).cast("string"), F.lit(" more bytes …")))
    part = rows.join(streams.select(*KEY, F.col(raw).alias("_raw")), KEY)
    lines = F.when(F.col("left") > 0, F.array_join(dump_lines(F.col("_raw"), F.col("offset"), F.col("shown")), "\n"))
    part = part.select(*KEY, "offset", "label", F.concat(F.concat_ws("\n", head, lines, rest), F.lit("\n")).alias("text"))
    whole = part.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("offset", "label", "text"))).alias("s"))
    return whole.select(*KEY, F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("dump"))


def stream_faults(text: Column) -> Column:
    """What is wrong with an edited content stream, as an array of words."""
    bare = F.regexp_replace(text, r"\((?:\\.|[^\\)])*\)", "")

    def count(word: str) -> Column:
        return F.regexp_count(bare, F.lit(rf"(?<!\S){word}(?!\S)"))

    return F.array_compact(F.array(
        F.when(text.contains("\0"), "NUL byte"), F.when(text.rlike(r"[\x01-\x08\x0b\x0e-\x1f]"), "control character"),
        F.when(count("BT") != count("ET"), "BT/ET unbalanced"), F.when(count("q") != count("Q"), "q/Q unbalanced"),
    ))


def edit_intent(text: Column) -> Column:
    """Whether a request asks for an edit rather than an answer."""
    return F.when(text.rlike(r"(?i)\b(change|replace|edit|modify|update|delete|remove|insert|add|move|rename|rotate|set)\b"), "edit").otherwise("chat")


def reply_block(text: Column) -> Column:
    """The fenced block of a reply; where its end is missing, all that follows its beginning."""
    whole = F.regexp_extract(text, r"(?s)```[a-z]*\n(.*?)```", 1)
    return F.when(whole != "", whole).otherwise(F.regexp_extract(text, r"(?s)```[a-z]*\n(.*)$", 1))


def font_family(name: Column) -> Column:
    """CSS family of a base font name without its subset prefix."""
    bare = F.regexp_replace(name, r"^[A-Z]{6}\+", "")
    return (
        F.when(bare.rlike("(?i)courier|mono|consol|typewriter"), "monospace").when(bare.rlike("(?i)times|serif|georgia|garamond|roman|minion|palatino"), "serif").otherwise("sans-serif")
    )


def font_style(name: Column) -> Column:
    return F.concat_ws(" ", F.when(name.rlike("(?i)italic|oblique"), "italic"), F.when(name.rlike("(?i)bold|black|heavy"), "bold"))


def renderable(code_point: Column) -> Column:
    return (code_point >= 32) & ~code_point.between(0xD800, 0xDFFF) & ~code_point.isin(0xFFFD, 0xFFFF)
