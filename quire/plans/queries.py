"""Queries over the driver's tables, each with the SQL that predicts its rows.

Closed-loop queries write a PDF for every row of ``documents``, parse it back,
and ask the engine; plain SQL over ``documents`` knows the answer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import formats, forms, graph, layout, pdfx, relink, search, text, versions
from quire.operators.corpus import Corpus, first_of
from quire.session import joins_by_measure, shared_dir, written
from quire.sources import pdf

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            joins_by_measure(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generated(spark: SparkSession, sf_dir: str, kind: str = "lay1") -> DataFrame:
    return pdf.generate(table(spark, sf_dir, "documents"), kind)


_saved: dict[tuple, Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str, kind: str = "lay1") -> Corpus:
    """The corpus of a kind, parsed and saved by path by the first question of a session that needs it; others read of it what they ask."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _saved:
        docs = table(spark, sf_dir, "documents")
        n = pdf.tasks_of(docs)
        _saved[key] = Corpus(pdf.generate(docs, kind, then=pdf.parsing(), tasks=n)).by_path(f"corpus-{kind}", n)
    return _saved[key]


def with_doc(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.regexp_extract("path", r"(-?\d+)\.pdf$", 1).cast("long"))


LINES = "length(text) - length(replace(text, chr(10), '')) + 1"


@query("q01_file_header", "SELECT doc_id, '1.4' AS version, 6 AS n_objects, 7 AS n_entries, true AS has_marker FROM documents")
def q01(spark, sf):
    c = corpus(spark, sf)
    return with_doc(c.parsed).select("doc_id", "version", F.size("objects").alias("n_objects"), F.size("xref").alias("n_entries"), F.col("binary_marker").isNotNull().alias("has_marker"))


@query("q02_entry_counts", "SELECT doc_id, 6 AS n_in_use, 1 AS n_free, 0 AS n_compressed FROM documents")
def q02(spark, sf):
    return with_doc(graph.entry_counts(corpus(spark, sf))).drop("file_id", "path")


def _info(c: Corpus) -> DataFrame:
    info = c.trailer().where("key = 'Info'").select("file_id", "path", F.col("ref_num").alias("obj_num"))
    rows = c.nodes.where("depth = 1 and key in ('Title', 'Author')").join(info, ["file_id", "path", "obj_num"], "left_semi")
    return with_doc(rows).groupBy("doc_id").agg(F.max(F.when(F.col("key") == "Title", F.col("str_v"))).alias("title"), F.max(F.when(F.col("key") == "Author", F.col("str_v"))).alias("author"))


@query("q03_info_dictionary", "SELECT doc_id, lang AS title, source AS author FROM documents")
def q03(spark, sf):
    return _info(corpus(spark, sf))


@query(
    "q04_decoded_length",
    f"""SELECT doc_id, length(text) - (n - 1) + e + 9 * n + 26 AS n_bytes FROM (SELECT doc_id, text, {LINES} AS n,
        length(text) - length(translate(text, '()' || chr(92), '')) AS e FROM documents)""",
)
def q04(spark, sf):
    return with_doc(text.content_bytes(corpus(spark, sf))).select("doc_id", F.octet_length("stream_decoded").cast("long").alias("n_bytes"))


@query("q05_shown_text", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def q05(spark, sf):
    runs = with_doc(text.text_runs(text.content_bytes(corpus(spark, sf))))
    lines = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("op_ix", "text"))).alias("r"))
    return lines.select("doc_id", F.sha2(F.array_join(F.transform("r", lambda x: x["text"]), "\n"), 256).alias("text_sha256"))


def _packed(spark, sf, kind):
    c = corpus(spark, sf, kind)
    return _info(c).join(with_doc(graph.entry_counts(c)).select("doc_id", "n_compressed"), "doc_id")


@query("q06_object_stream", "SELECT doc_id, lang AS title, source AS author, 2 AS n_compressed FROM documents")
def q06(spark, sf):
    return _packed(spark, sf, "lay2")


@query("q07_predicted_xref_stream", "SELECT doc_id, lang AS title, source AS author, 2 AS n_compressed FROM documents")
def q07(spark, sf):
    return _packed(spark, sf, "lay2p")


@query("q08_back_references", "SELECT doc_id, k AS obj_num, CASE k WHEN 2 THEN 2 ELSE 1 END AS n_refs FROM documents, (SELECT unnest([1,2,3,4,5,6]) AS k)")
def q08(spark, sf):
    return with_doc(graph.reference_counts(corpus(spark, sf))).select("doc_id", "obj_num", "n_refs")


@query(
    "q09_classification",
    "SELECT doc_id, k AS obj_num, ['Catalog','Pages Tree','Page','Content Stream','Font (Type1)','Document Info'][k] AS type_label FROM documents, (SELECT unnest([1,2,3,4,5,6]) AS k)",
)
def q09(spark, sf):
    return with_doc(graph.classify(corpus(spark, sf))).select("doc_id", "obj_num", "type_label")


@query("q10_object_sizes", "SELECT doc_id, 0 AS unaccounted, 6 AS n_positive FROM documents")
def q10(spark, sf):
    rows = with_doc(layout.object_sizes(corpus(spark, sf)))
    return rows.groupBy("doc_id").agg((F.sum("size") - (F.max("length") - F.min("offset"))).alias("unaccounted"), F.count_if(F.col("size") > 0).alias("n_positive"))


@query("q11_link_graph", "SELECT target, count(*) AS n_refs, min(page_id) AS min_from FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY target")
def q11(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n_refs"), F.min("page_id").alias("min_from"))


@query("q12_pointer_lookup", "SELECT coalesce(o_orderstatus, 'dangling') AS target, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def q12(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey").join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy(F.coalesce("o_orderstatus", F.lit("dangling")).alias("target")).agg(F.count("*").alias("n"))


def ops(spark, sf, kind="lay1"):
    return text.content_ops(text.content_bytes(corpus(spark, sf, kind)))


@query(
    "q13_op_categories",
    f"""SELECT doc_id, c.category, CASE c.category WHEN 'text_state' THEN 3 WHEN 'text_pos' THEN n + 1 ELSE n END AS n_ops, c.category_ix
        FROM (SELECT doc_id, {LINES} AS n FROM documents), (VALUES ('text_state', 0), ('text_pos', 1), ('text_show', 2)) c(category, category_ix)""",
)
def q13(spark, sf):
    return with_doc(text.category_counts(ops(spark, sf))).select("doc_id", "category", "n_ops", "category_ix")


@query(
    "q14_first_shown",
    """SELECT doc_id, CASE WHEN length(s) > 60 THEN left(s, 60) || '…' ELSE s END AS summary
       FROM (SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '[^ -~]', '·', 'g') AS s FROM documents)""",
)
def q14(spark, sf):
    shown = ops(spark, sf).where("op = 'Tj'")
    return with_doc(shown).groupBy("doc_id").agg(F.min_by("summary", "op_ix").alias("summary"))


@query("q15_distinct_operators", "SELECT doc_id, 6 AS n_ops FROM documents")
def q15(spark, sf):
    return with_doc(ops(spark, sf)).groupBy("doc_id").agg(F.countDistinct("op").alias("n_ops"))


@query(
    "q16_balance",
    "SELECT doc_id, o AS n_open, c AS n_close, o <> c AS unbalanced FROM (SELECT doc_id, length(text) - length(replace(text, '(', '')) AS o, length(text) - length(replace(text, ')', '')) AS c FROM documents)",
)
def q16(spark, sf):
    count = lambda x: F.regexp_count("text", F.lit(x)).cast("long")
    return table(spark, sf, "documents").select("doc_id", count(r"\(").alias("n_open"), count(r"\)").alias("n_close"), (count(r"\(") != count(r"\)")).alias("unbalanced"))


@query(
    "q17_binary_heuristic",
    "SELECT doc_id, k AS n_odd, k > 0.15 * length(h) AS is_binary FROM (SELECT doc_id, left(text, 512) AS h, length(regexp_replace(left(text, 512), '[\\t\\n\\r -~]', '', 'g')) AS k FROM documents)",
)
def q17(spark, sf):
    head = F.substring("text", 1, 512)
    odd = F.length(F.regexp_replace(head, r"[\t\n\r\x20-\x7e]", ""))
    return table(spark, sf, "documents").select("doc_id", odd.cast("long").alias("n_odd"), text.is_binary(F.encode("text", "ISO-8859-1")).alias("is_binary"))


@query(
    "q18_content_heuristic",
    """SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(left(text, 400), '\\s+', ' ', 'g')), ' '), lambda x: x IN ('the','of','and','de','la','der'))) AS n_words FROM documents""",
)
def q18(spark, sf):
    words = F.split(F.trim(F.regexp_replace(F.substring("text", 1, 400), r"\s+", " ")), " ")
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(words, lambda w: w.isin("the", "of", "and", "de", "la", "der"))).cast("long").alias("n_words"))


@query(
    "q19_sorted_entries",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'
       ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100""",
)
def q19(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return layout.page_of(rows, [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey"], 0, 100)


@query("q20_search_page", "SELECT event_id, event_type FROM events WHERE contains(CAST(event_id AS VARCHAR), '7') ORDER BY event_id LIMIT 200 OFFSET 600")
def q20(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return layout.page_of(layout.search_number(rows, "event_id", "7"), ["event_id"], 3, 200)


@query("q21_member_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q21(spark, sf):
    chosen = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(chosen, "c_custkey", "left_semi")


@query("q22_distances", "SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) - event_id AS size FROM events")
def q22(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id")
    return layout.sizes(rows, ["user_id"], "event_id", F.lit(1000000000).cast("long")).select("event_id", "size")


@query("q23_running_offset", "SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM documents")
def q23(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    return layout.running_total(rows, "doc_id", "n_chars", 1 << 16).select("doc_id", "begin")


@query(
    "q24_interval_join",
    """WITH i AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS b, sum(n_chars) OVER (ORDER BY doc_id) AS e FROM documents)
       SELECT doc_id, count(*) AS n_points, min(event_id) AS first_point FROM events JOIN i ON event_id * 97 >= b AND event_id * 97 < e GROUP BY doc_id""",
)
def q24(spark, sf):
    docs = layout.running_total(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1 << 16)
    intervals = docs.select("doc_id", "begin", (F.col("begin") + F.col("n_chars")).alias("end"))
    points = table(spark, sf, "events").select("event_id", (F.col("event_id") * 97).alias("at"))
    found = layout.range_join(points, intervals, "at", "begin", "end", 4096)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_points"), F.min("event_id").alias("first_point"))


@query(
    "q25_gaps",
    "SELECT user_id, event_id + 1 AS gap_begin, n AS gap_end FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > event_id + 1",
)
def q25(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("b"), (F.col("event_id") + 1).alias("e"))
    return layout.gaps(rows, ["user_id"], "b", "e")


@query("q26_absent", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q26(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("q27_coverage", "SELECT lang, round(count(quality) * 100.0 / count(*), 2)::DOUBLE AS pct, max(n_chars) AS widest FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) GROUP BY lang")
def q27(spark, sf):
    marks = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(marks, "doc_id", "left")
    return rows.groupBy("lang").agg(layout.coverage(F.count("quality"), F.count("*")).alias("pct"), F.max("n_chars").alias("widest"))


_ALL = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(
    "q28_first_wins",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ALL}) AS k FROM lineitem) WHERE k = 1",
)
def q28(spark, sf):
    return first_of(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _ALL.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "q29_cmap",
    "SELECT doc_id, count(DISTINCT c) AS n_mappings, max(unicode(c)) AS max_code FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY doc_id",
)
def q29(spark, sf):
    chars = F.filter(F.array_distinct(F.split("text", "")), lambda c: c != "")
    one = lambda c: F.concat(F.lit("<"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0"), F.lit("> <"), F.hex(F.encode(c, "UTF-16BE")), F.lit(">\n"))
    source = F.concat(F.lit("/CMapName /own def\n1 beginbfchar\n"), F.array_join(F.transform(chars, one), ""), F.lit("endbfchar"))
    rows = table(spark, sf, "documents").select(F.lit("").alias("file_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.lit(0).alias("obj_num"), F.encode(source, "ISO-8859-1").alias("stream_decoded"))
    maps = formats.rendering_map(formats.parse_cmaps(rows))
    return with_doc(maps).groupBy("doc_id").agg(F.count("*").alias("n_mappings"), F.max("code_point").alias("max_code"))


@query("q30_bitmap", "SELECT label, count(DISTINCT vec_id) AS present_count, max(vec_id) AS last_cid FROM embeddings GROUP BY label")
def q30(spark, sf):
    ids = table(spark, sf, "embeddings").select("label", "vec_id")
    cells = ids.groupBy("label", F.floor(F.col("vec_id") / 8).alias("at")).agg(F.bit_or(F.expr("shiftright(128, cast(pmod(vec_id, 8) as int))")).alias("bits"))
    rows = cells.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"), F.max("at").alias("top"))
    raw = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), "top"), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0))), 2, "0")), ""))
    return formats.cid_sets(rows.select("label", raw.alias("raw")), "raw").select("label", "present_count", "last_cid")


@query(
    "q31_palette",
    """SELECT p_partkey, '#' || printf('%02x%02x%02x', r, g, b) AS hex, (r * 0.299 + g * 0.587 + b * 0.114 < 128) AS dark
       FROM (SELECT p_partkey, p_size * 5 AS r, (p_size * 3) % 256 AS g, p_partkey % 256 AS b FROM part)""",
)
def q31(spark, sf):
    r, g, b = F.col("p_size") * 5, F.pmod(F.col("p_size") * 3, F.lit(256)), F.pmod("p_partkey", F.lit(256))
    return table(spark, sf, "part").select("p_partkey", formats.rgb_hex(r, g, b).alias("hex"), formats.is_dark(r, g, b).alias("dark"))


@query("q32_codec_round_trip", "SELECT item_id, sha256(text) AS hex_sha256, sha256(text) AS a85_sha256, sha256(text) AS chain_sha256 FROM benchmark")
def q32(spark, sf):
    def run(batches):
        import hashlib

        from quire.functions.codecs import decode_chain, encode_chain

        for b in batches:
            raws = [(t or "").encode() for t in b.column(1).to_pylist()]
            out = [[hashlib.sha256(decode_chain(encode_chain(r, f), f)).hexdigest() for r in raws] for f in (["ASCIIHexDecode"], ["ASCII85Decode"], ["ASCII85Decode", "FlateDecode"])]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["item_id", "hex_sha256", "a85_sha256", "chain_sha256"])

    return table(spark, sf, "benchmark").select("item_id", "text").mapInArrow(run, "item_id long, hex_sha256 string, a85_sha256 string, chain_sha256 string")


@query("q33_value_round_trip", "SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM conversations")
def q33(spark, sf):
    def run(batches):
        import hashlib

        from quire.functions.lexer import Value, parse
        from quire.functions.pdfx import from_json, to_json
        from quire.functions.write import body, dictionary

        for b in batches:
            role, sha = [], []
            for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                v = dictionary(Role=r or "", Text=Value("LiteralString", (t or "").encode().decode("latin-1")))
                back = parse(body(from_json(json.loads(json.dumps(to_json(v))))))
                role.append(back.get("Role").name)
                sha.append(hashlib.sha256(back.get("Text").data.encode("latin-1")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(role), pa.array(sha)], names=["conv_id", "turn", "role", "text_sha256"])

    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, role string, text_sha256 string")


@query(
    "q34_font_tables",
    """SELECT doc_id, t.tag AS tag, CASE t.k WHEN 0 THEN 60 WHEN 1 THEN 60 + (n + 3) // 4 * 4 ELSE 60 + (n + 3) // 4 * 4 + (least(n, 54) + 3) // 4 * 4 END AS "offset",
              least(n, t.most) AS length, t.d AS "desc"
       FROM (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
            (VALUES (0, 'glyf', 1000000000, 'Glyph outlines'), (1, 'head', 54, 'Font header'), (2, 'maxp', 6, 'Maximum profile')) t(k, tag, most, d)""",
)
def q34(spark, sf):
    """Directories of fonts generated from document texts: three tables each, offsets ascending."""

    def run(batches):
        from quire.functions.formats import sfnt, ttf_tables

        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode()
                rows += [(i, x["tag"], x["offset"], x["length"], x["desc"]) for x in ttf_tables(sfnt({"glyf": raw, "head": raw[:54], "maxp": raw[:6]}))]
            c = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "tag", "offset", "length", "desc"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, tag string, offset long, length long, desc string")


def _edited(spark, sf, kind: str, where: str) -> tuple[DataFrame, DataFrame]:
    """Manifest, and exploded files whose information dictionary has a new title where ``where`` holds; files are exploded once."""
    out = written(_exploded(spark, sf, kind, where), "exploded")
    return pdfx.manifest_of(out), _with_title(out)


def _exploded(spark, sf, kind: str, where: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("edit", F.expr(where))
    return pdfx.explode_files(pdf.generate(docs, kind, ("edit",)), ("edit",))


def _with_title(out: DataFrame) -> DataFrame:
    new = F.lit(json.dumps({"_obj": "6 0", "value": {"Title": "edited", "Author": "someone"}})).cast("binary")
    return out.select("path", "name", F.when(F.col("edit") & (F.col("name") == "objects/00006_0.pdfjson"), new).otherwise(F.col("data")).alias("data"))


@query("q35_change_detection", "SELECT doc_id, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS n_modified, 6 AS n_objects FROM documents")
def q35(spark, sf):
    rows, files = _edited(spark, sf, "lay1", "lang = 'de'")
    return with_doc(pdfx.changes(rows, files)).groupBy("doc_id").agg(F.count_if("modified").alias("n_modified"), F.count("*").alias("n_objects"))


@query("q36_export_link_identity", "SELECT doc_id, true AS identical FROM documents")
def q36(spark, sf):
    files = generated(spark, sf)
    back = pdfx.link(pdfx.explode_files(files)).select("path", F.sha2("content", 256).alias("back"))
    return files.select("doc_id", "path", F.sha2("content", 256).alias("was")).join(back, "path").select("doc_id", (F.col("was") == F.col("back")).alias("identical"))


@query("q37_repack", "SELECT doc_id, 'edited' AS title, 'someone' AS author, 2 AS n_compressed FROM documents")
def q37(spark, sf):
    files = _with_title(_exploded(spark, sf, "lay2", "true"))
    # Linked and parsed once, however often it is asked.
    c = Corpus(written(Corpus.from_binary(pdfx.link(files)).parsed, "repacked"))
    return _info(c).join(with_doc(graph.entry_counts(c)).select("doc_id", "n_compressed"), "doc_id")


@query("q38_text_runs", f"SELECT doc_id, {LINES} AS n_runs, 720.0::DOUBLE AS last_y, (720 - 14 * ({LINES} - 1))::DOUBLE AS last_y_leading FROM documents")
def q38(spark, sf):
    def runs(kind):
        rows = with_doc(text.text_runs(text.content_bytes(corpus(spark, sf, kind))))
        return rows.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.max_by("y", "op_ix").alias("last_y"))

    return runs("lay1").join(runs("lay3").select("doc_id", F.col("last_y").alias("last_y_leading")), "doc_id")


@query("q39_stream_ingest", "SELECT doc_id, 6 AS n_objects, '1.4' AS version FROM documents")
def q39(spark, sf):
    from quire.streaming.ingest import ingest

    folder = f"{shared_dir(spark)}/quire/stream-{uuid.uuid4().hex}"
    generated(spark, sf).select("path", "content").write.parquet(f"{folder}/in")
    source = spark.readStream.schema("path string, content binary").parquet(f"{folder}/in")
    ingest(source, f"{folder}/table", f"{folder}/checkpoint")
    c = Corpus.open(spark, f"{folder}/table")
    return with_doc(c.parsed).select("doc_id", F.size("objects").alias("n_objects"), "version")


@query(
    "q40_recursive_paths",
    """SELECT 0 AS depth, r_name AS trail FROM region UNION ALL SELECT 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT 2, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def q40(spark, sf):
    parts = {n: table(spark, sf, n) for n in ("region", "nation", "supplier")}
    tree = parts["region"].select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    tree = tree.union(parts["nation"].select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name"))
    tree = tree.union(parts["supplier"].select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name"))
    return spark.sql(
        """WITH RECURSIVE walk(id, depth, trail) AS (
             SELECT id, 0, name FROM {tree} WHERE parent IS NULL
             UNION ALL SELECT t.id, w.depth + 1, concat(w.trail, '/', t.name) FROM walk w JOIN {tree} t ON t.parent = w.id)
           SELECT depth, trail FROM walk""",
        tree=tree,
    )


@query("q41_json_field", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def q41(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("q42_page_order", "SELECT doc_id, 3 AS obj_num, 0 AS page_ix FROM documents")
def q42(spark, sf):
    return with_doc(graph.page_order(corpus(spark, sf))).select("doc_id", "obj_num", "page_ix")


@query(
    "q43_document_tree",
    "SELECT doc_id, s AS section, CASE s WHEN 'Body' THEN 6 WHEN 'Trailer' THEN 3 ELSE 1 END AS n_lines FROM documents, (SELECT unnest(['Header','Body','XRef','Trailer']) AS s)",
)
def q43(spark, sf):
    return with_doc(graph.document_tree(corpus(spark, sf))).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


@query("q44_capabilities", "SELECT doc_id, k AS obj_num, k = 4 AS is_content_stream, k = 5 AS is_font, false AS is_image FROM documents, (SELECT unnest([1,2,3,4,5,6]) AS k)")
def q44(spark, sf):
    return with_doc(graph.capabilities(corpus(spark, sf))).select("doc_id", "obj_num", "is_content_stream", "is_font", "is_image")


@query("q45_manifest", "SELECT doc_id, 6 AS n_objects, 1 AS n_streams, 1 AS n_stored FROM documents")
def q45(spark, sf):
    rows = with_doc(pdfx.manifest(generated(spark, sf)))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_objects"), F.count_if("has_stream").alias("n_streams"), F.count_if(F.col("stream_type").isNotNull()).alias("n_stored")
    )


@query("q46_fonts", "SELECT doc_id, 'Helvetica' AS base_font, 'Type1' AS subtype, false AS is_embedded FROM documents")
def q46(spark, sf):
    return with_doc(formats.fonts(corpus(spark, sf))).select("doc_id", "base_font", "subtype", "is_embedded")


@query("q47_page_resources", "SELECT doc_id, 'F1' AS name, 5 AS ref_num, 816.0::DOUBLE AS px_width, 1056.0::DOUBLE AS px_height FROM documents")
def q47(spark, sf):
    c = corpus(spark, sf)
    return with_doc(formats.page_resources(c, "Font")).select("doc_id", "name", "ref_num").join(with_doc(formats.page_boxes(c)).select("doc_id", "px_width", "px_height"), "doc_id")


@query("q48_archive_round_trip", "SELECT doc_id, true AS identical FROM documents")
def q48(spark, sf):
    files = generated(spark, sf, "lay2p")
    exploded = pdf.generate(table(spark, sf, "documents"), "lay2p", then=pdfx.zipped_and_back())
    back = pdfx.link(exploded).select("path", F.sha2("content", 256).alias("back"))
    return files.select("doc_id", "path", F.sha2("content", 256).alias("was")).join(back, "path").select("doc_id", (F.col("was") == F.col("back")).alias("identical"))


@query("q49_owning_page", "SELECT doc_id, 4 AS obj_num, 3 AS page_num FROM documents")
def q49(spark, sf):
    return with_doc(graph.owning_pages(corpus(spark, sf))).select("doc_id", "obj_num", "page_num")


@query("q50_reference_targets", "SELECT target_type AS target, n * c AS n FROM (VALUES ('Catalog', 1), ('Pages', 2), ('Page', 1), ('Font', 1), ('none', 2)) t(target_type, n), (SELECT count(*) AS c FROM documents)")
def q50(spark, sf):
    c = corpus(spark, sf)
    return graph.resolve(c.nodes, c.objects).groupBy(F.coalesce("target_type", F.lit("none")).alias("target")).agg(F.count("*").alias("n"))


@query("q51_hex_dump", "SELECT doc_id, (octet_length(encode(text)) + 15) // 16 AS n_lines FROM documents")
def q51(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.hex_dump(F.encode("text", "UTF-8"), 1 << 30).alias("d"))
    return rows.select("doc_id", F.when(F.length("d") == 0, F.lit(0)).otherwise(F.regexp_count("d", F.lit("\n")) + 1).cast("long").alias("n_lines"))


@query("q52_glyph_grid", "SELECT label, count(*) AS n, CASE WHEN count(*) <= 256 THEN 16 WHEN count(*) <= 1024 THEN 32 WHEN count(*) <= 4096 THEN 64 WHEN count(*) <= 16384 THEN 128 ELSE 256 END AS width FROM embeddings GROUP BY label")
def q52(spark, sf):
    rows = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return rows.select("label", "n", layout.grid_width(F.col("n")).alias("width"))


@query(
    "q53_stream_faults",
    """SELECT doc_id, concat_ws(', ', CASE WHEN doc_id % 3 = 0 THEN 'control character' END, CASE WHEN doc_id % 5 = 0 THEN 'BT/ET unbalanced' END,
              CASE WHEN doc_id % 2 = 0 THEN 'q/Q unbalanced' END) AS faults FROM documents""",
)
def q53(spark, sf):
    tail = lambda n, yes, no: F.when(F.col("doc_id") % n == 0, yes).otherwise(no)
    stream = F.concat(F.lit("q BT (ET Q "), "lang", F.lit(") Tj"), tail(5, "", " ET"), tail(2, "", " Q"), tail(3, " \x02", ""))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.stream_faults(stream), ", ").alias("faults"))


@query("q54_absent_numbers", "SELECT i AS o_custkey FROM range(0, 3000) t(i) WHERE i NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def q54(spark, sf):
    return layout.absent(table(spark, sf, "orders").select("o_custkey").distinct(), "o_custkey", 0, 3000)


@query(
    "q55_reads_as_content",
    """SELECT doc_id, doc_id % 3 = 1 OR doc_id % 3 = 0 AND len(list_filter(string_split(trim(regexp_replace(left(text, 400), '\\s+', ' ', 'g')), ' '),
              lambda x: x IN ('BT','ET','Tf','Tm','Td','TD','Tj','TJ','q','Q','cm','gs','rg','RG','cs','CS','scn','SCN','re','m','l','h','S','f','Do','w'))) >= 3 AS reads_as_content FROM documents""",
)
def q55(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("BT 1 2 Td ET "), "lang")).otherwise(F.concat(F.lit("BT "), "lang", F.lit(" 1")))
    return table(spark, sf, "documents").select("doc_id", text.is_content(F.encode(raw, "ISO-8859-1")).alias("reads_as_content"))


@query("q56_incremental_updates", "SELECT doc_id, 'second edit' AS title, source AS author, 3 AS n_sections, 7 AS n_entries FROM documents")
def q56(spark, sf):
    c = corpus(spark, sf, "lay4")
    n = with_doc(c.sections).groupBy("doc_id").agg(F.countDistinct("section_ix").alias("n_sections"))
    return _info(c).join(n, "doc_id").join(with_doc(c.xref).groupBy("doc_id").agg(F.count("*").alias("n_entries")), "doc_id")


@query("q57_page_tree", f"SELECT doc_id, 4 + 3 * i AS obj_num, i - 1 AS page_ix FROM (SELECT doc_id, unnest(range(1, {LINES} + 1)) AS i FROM documents)")
def q57(spark, sf):
    return with_doc(graph.page_order(corpus(spark, sf, "book"))).select("doc_id", "obj_num", "page_ix")


@query("q58_pages_of_streams", f"SELECT doc_id, 4 + 3 * i + k AS obj_num, 4 + 3 * i AS page_num FROM (SELECT doc_id, unnest(range(1, {LINES} + 1)) AS i FROM documents), (VALUES (1), (2)) t(k)")
def q58(spark, sf):
    return with_doc(graph.owning_pages(corpus(spark, sf, "book"))).select("doc_id", "obj_num", "page_num")


@query("q59_text_of_pages", f"SELECT doc_id, {LINES} AS n_pages, 2 * ({LINES}) AS n_runs, sha256(replace(text, chr(10), '')) AS text_sha256 FROM documents")
def q59(spark, sf):
    c = corpus(spark, sf, "book")
    rows = with_doc(text.text_runs(text.content_bytes(c))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("obj_num", "op_ix", "text"))).alias("r"), F.countDistinct("obj_num").alias("n_pages"))
    return rows.select("doc_id", "n_pages", F.size("r").cast("long").alias("n_runs"), F.sha2(F.array_join(F.transform("r", lambda x: x["text"]), ""), 256).alias("text_sha256"))


@query("q60_brief_values", "SELECT doc_id, '(' || lang || ')' AS title, '<< 2 entries >>' AS info, '[ 1 items ]' AS kids, '2 0 R' AS pages FROM documents")
def q60(spark, sf):
    rows = with_doc(graph.value_tree(corpus(spark, sf)))
    pick = lambda obj, path: F.max(F.when((F.col("obj_num") == obj) & (F.coalesce("key_path", F.lit("")) == path), F.col("brief")))
    return rows.groupBy("doc_id").agg(pick(6, "Title").alias("title"), F.max(F.when(F.expr("obj_num = 6 and depth = 0"), F.col("brief"))).alias("info"), pick(2, "Kids").alias("kids"), pick(1, "Pages").alias("pages"))


@query(
    "q61_entries_by_size",
    """SELECT l_orderkey * 10 + l_linenumber AS obj_num, l_quantity AS size FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_quantity DESC, obj_num LIMIT 200""",
)
def q61(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obj_num"), F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("etype"))
    return layout.sort_entries(rows, "size", True, "R").limit(200).drop("etype")


@query("q62_export_bounds", "SELECT doc_id, 0 AS unaccounted, 6 AS n_bounded FROM documents")
def q62(spark, sf):
    rows = with_doc(layout.export_bounds(corpus(spark, sf)))
    return rows.groupBy("doc_id").agg((F.sum(F.col("end") - F.col("offset")) - (F.max("startxref") - F.min("offset"))).alias("unaccounted"), F.count("end").alias("n_bounded"))


@query("q63_hosts_of_members", "SELECT doc_id, 2 AS n_at_host, 6 AS n_offsets FROM documents")
def q63(spark, sf):
    rows = with_doc(layout.effective_offsets(corpus(spark, sf, "lay2")))
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("n_offsets"))
    return n.select("doc_id", (F.col("n") - F.col("n_offsets")).alias("n_at_host"), "n_offsets")


@query("q64_index_kinds", "SELECT doc_id, 'table' AS classic, 'stream' AS packed, false AS linearized, true AS sound FROM documents")
def q64(spark, sf):
    one, two = (with_doc(corpus(spark, sf, k).files) for k in ("lay1", "lay2p"))
    one = one.select("doc_id", F.col("xref_type").alias("classic"), "linearized", F.col("error").isNull().alias("sound"))
    return one.join(two.select("doc_id", F.col("xref_type").alias("packed")), "doc_id")


@query(
    "q65_requests_and_replies",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(change|replace|edit|modify|update|delete|remove|insert|add|move|rename|rotate|set)\\b') THEN 'edit' ELSE 'chat' END AS intent,
              sha256(text || chr(10)) AS block_sha256, sha256(text) AS open_sha256 FROM conversations""",
)
def q65(spark, sf):
    rows = table(spark, sf, "conversations")
    closed, left_open = F.concat(F.lit("Here:\n```pdf\n"), "text", F.lit("\n```\nDone")), F.concat(F.lit("Here:\n```\n"), "text")
    return rows.select("conv_id", "turn", text.edit_intent(F.col("text")).alias("intent"), F.sha2(text.reply_block(closed), 256).alias("block_sha256"), F.sha2(text.reply_block(left_open), 256).alias("open_sha256"))


_NAMES = ["ABCDEF+Courier-Bold", "Times-Italic", "Helvetica", "XYZABC+Georgia-BoldItalic", "DejaVuSansMono-Oblique"]


@query(
    "q66_font_families",
    """SELECT p_partkey, ['monospace','serif','sans-serif','serif','monospace'][p_partkey % 5 + 1] AS family, ['bold','italic','','italic bold','italic'][p_partkey % 5 + 1] AS style,
              c >= 32 AND NOT (c BETWEEN 55296 AND 57343) AND c NOT IN (65533, 65535) AS renderable FROM (SELECT p_partkey, p_partkey * 37 % 66000 AS c FROM part)""",
)
def q66(spark, sf):
    name = F.array(*map(F.lit, _NAMES))[(F.col("p_partkey") % 5).cast("int")]
    return table(spark, sf, "part").select("p_partkey", text.font_family(name).alias("family"), text.font_style(name).alias("style"), text.renderable(F.col("p_partkey") * 37 % 66000).alias("renderable"))


@query("q67_printable_text", "SELECT doc_id, sha256(regexp_replace(replace(text, chr(13), '') || '.', '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]', '.', 'g')) AS shown_sha256 FROM documents")
def q67(spark, sf):
    raw = F.encode(F.concat("text", F.lit("\r\x01")), "ISO-8859-1")
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.printable(raw), 256).alias("shown_sha256"))


@query("q68_text_modes", "SELECT doc_id, false AS invisible, 2 AS n_first FROM documents")
def q68(spark, sf):
    rows = ops(spark, sf)
    n = with_doc(text.first_operators(rows, 2)).groupBy("doc_id").agg(F.count("*").alias("n_first"))
    return with_doc(text.has_invisible_text(rows)).select("doc_id", "invisible").join(n, "doc_id")


@query(
    "q69_size_labels",
    """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) ELSE printf('%.2f MB', floor(n / 1048576 * 100 + 0.5) / 100) END AS label
       FROM (SELECT doc_id, n_chars * n_chars // 64 AS n FROM documents)""",
)
def q69(spark, sf):
    n = F.floor(F.col("n_chars") * F.col("n_chars") / 64)
    return table(spark, sf, "documents").select("doc_id", layout.byte_label(n).alias("label"))


@query("q70_written_references", "SELECT doc_id, doc_id::INT AS one, (doc_id + 1)::INT AS two, 2 AS n FROM documents")
def q70(spark, sf):
    said = F.concat(F.lit("see "), F.col("doc_id").cast("string"), F.lit(" 0 R, ["), (F.col("doc_id") + 1).cast("string"), F.lit("  0 R] but not 3 0 Rx nor x7 0 R"))
    found = graph.link_targets(said)
    return table(spark, sf, "documents").select("doc_id", found[0].alias("one"), found[1].alias("two"), F.size(found).alias("n"))


@query(
    "q71_change_status",
    """SELECT doc_id, s AS status, CASE WHEN s = 'same' THEN 6 - (lang = 'de')::INT - (lang = 'fr')::INT ELSE 1 END AS n FROM documents, (VALUES ('same'), ('modified'), ('deleted'), ('added')) t(s)
       WHERE s = 'same' OR s = 'modified' AND lang = 'de' OR s = 'deleted' AND lang = 'fr' OR s = 'added' AND lang = 'es'""",
)
def q71(spark, sf):
    rows, files = _edited(spark, sf, "lay1", "lang = 'de'")
    langs = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "lang")
    kept = files.join(langs, "path").where("not (lang = 'fr' and name = 'objects/00005_0.pdfjson')").select("path", "name", "data")
    new = langs.where("lang = 'es'").select("path", F.lit("objects/00099_0.pdfjson").alias("name"), F.lit(b"{}").alias("data"))
    return with_doc(pdfx.changes(rows, kept.union(new))).groupBy("doc_id", "status").agg(F.count("*").alias("n"))


@query("q72_objects_of_sections", "SELECT doc_id, 0 AS page, 6 AS n_objects FROM documents")
def q72(spark, sf):
    c = corpus(spark, sf)
    sections = c.files.select("file_id", "path", F.lit(0).alias("page"), F.lit(0).cast("long").alias("section_offset"), F.col("length").alias("page_length"))
    return with_doc(layout.objects_by_section(c, sections)).select("doc_id", "page", F.size("obj_nums").alias("n_objects"))



@query(
    "q73_text_by_fonts",
    """SELECT doc_id, upper(coalesce(lang, '')) || coalesce(source, '') || 'Z' AS shown, 72.0::DOUBLE AS x1, round(72 + 6.0 * length(coalesce(lang, '')), 3)::DOUBLE AS x2,
              round(72 + 6.0 * length(coalesce(lang, '')) + 7.0 * length(coalesce(source, '')), 3)::DOUBLE AS x3 FROM documents""",
)
def q73(spark, sf):
    c = corpus(spark, sf, "type")
    runs = with_doc(text.text_runs(text.content_bytes(c), formats.page_fonts(c)))
    rows = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("op_ix", "text", F.round("x", 3).alias("x")))).alias("r"))
    return rows.select("doc_id", F.array_join(F.transform("r", lambda x: x["text"]), "").alias("shown"), *[F.col("r")[i]["x"].alias(f"x{i + 1}") for i in range(3)])


@query("q74_image_rows", "SELECT doc_id, o AS obj_num, 'png' AS format, greatest(1, least(64, octet_length(encode(coalesce(text, ''))))) AS width, CASE WHEN o = 4 THEN 0 ELSE 2 END AS colour_type, true AS sound FROM documents, (VALUES (4), (5)) t(o)")
def q74(spark, sf):
    rows = with_doc(formats.image_files(corpus(spark, sf, "image")))
    number = lambda at, n: F.conv(F.hex(F.substring("data", at, n)), 16, 10).cast("int")
    return rows.select("doc_id", "obj_num", "format", number(17, 4).alias("width"), number(26, 1).alias("colour_type"), F.col("error").isNull().alias("sound"))


@query("q75_file_strip", "SELECT doc_id, 15 AS header_end, 6 AS n_objects, 0 AS uncovered FROM documents")
def q75(spark, sf):
    c = corpus(spark, sf)
    rows = with_doc(layout.xref_strip(c).join(c.files.select("file_id", "path", "length"), ["file_id", "path"]))
    return rows.groupBy("doc_id").agg(
        F.max(F.when(F.col("is_gap") & (F.col("begin") == 0), F.col("end"))).alias("header_end"), F.count_if(~F.col("is_gap")).alias("n_objects"), (F.max("length") - F.sum(F.col("end") - F.col("begin"))).alias("uncovered"))


@query(
    "q76_coverage_bitmap",
    """SELECT custkey, string_agg(printf('%02X', b), '' ORDER BY i) AS coverage FROM (
         SELECT o_custkey AS custkey, i, coalesce(sum(DISTINCT CASE WHEN o_orderkey % 40 // 8 = i THEN 128 >> (o_orderkey % 8) END), 0)::INT AS b
         FROM orders JOIN (SELECT o_custkey AS k, max(o_orderkey % 40 // 8) AS top FROM orders GROUP BY 1) m ON o_custkey = k, range(5) r(i) WHERE i <= top GROUP BY 1, 2) GROUP BY 1""",
)
def q76(spark, sf):
    rows = table(spark, sf, "orders").select(F.lit("f").alias("file_id"), F.lit("p").alias("path"), F.col("o_custkey").alias("obj_num"), (F.col("o_orderkey") % 40).alias("cid"))
    return formats.coverage_bitmap(rows).select(F.col("obj_num").alias("custkey"), "coverage")


@query("q77_compression_ratio", "SELECT doc_id, CASE WHEN n_chars > 0 THEN round(1 - doc_id % 97 / n_chars, 4) END AS ratio FROM documents")
def q77(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(layout.compression_ratio(F.col("doc_id") % 97, F.col("n_chars")), 4).alias("ratio"))


@query(
    "q78_path_counts",
    """SELECT doc_id, (((coalesce(doc_id, 0) % 3) + 3) % 3)::BIGINT AS n_lines, 1::BIGINT AS n_moves, 1::BIGINT AS n_strokes, (((coalesce(doc_id, 0) % 2) + 2) % 2)::BIGINT AS n_rectangles, 0::BIGINT AS n_clips FROM documents""",
)
def q78(spark, sf):
    i = F.coalesce("doc_id", F.lit(0))
    drawn = F.concat(F.lit("q 0 0 m "), F.repeat(F.lit("5 5 l "), F.pmod(i, F.lit(3)).cast("int")), F.when(F.pmod(i, F.lit(2)) == 1, "1 1 2 2 re ").otherwise(""), F.lit("S (m l re S) Tj Q"))
    rows = table(spark, sf, "documents").select(F.lit("f").alias("file_id"), F.lit("p").alias("path"), F.col("doc_id").cast("int").alias("obj_num"), F.encode(drawn, "ISO-8859-1").alias("stream_decoded"))
    return text.path_counts(text.content_ops(rows)).select(F.col("obj_num").cast("long").alias("doc_id"), "n_lines", "n_moves", "n_strokes", "n_rectangles", "n_clips")


@query(
    "q79_glyph_filter",
    "SELECT p_partkey AS gid, p_name AS glyph FROM part WHERE contains(lower(p_name), 'a1') OR contains(p_partkey::VARCHAR, 'a1') UNION ALL SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '7') OR contains(p_partkey::VARCHAR, '7')",
)
def q79(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("gid"), F.col("p_name").alias("glyph"))
    return layout.search_glyphs(rows, "A1").union(layout.search_glyphs(rows, "7"))


@query(
    "q80_groups_of_a_page",
    "SELECT o_custkey AS file, o_orderkey % 7 AS \"group\", CASE WHEN o_orderkey % 7 < 4 THEN 'kind ' || (o_orderkey % 7) END AS lead_label FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL",
)
def q80(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("file_id"), F.lit("p").alias("path"), (F.col("o_orderkey") % 2).cast("int").alias("page"), (F.col("o_orderkey") % 7).cast("int").alias("group"))
    groups = rows.select("file_id", "path", "group", F.col("group").alias("first_obj")).distinct()
    pages = rows.groupBy("file_id", "path", "page").agg(F.collect_set("group").alias("shared_ids"))
    labels = rows.select("file_id", "path", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("obj_num")).distinct().withColumn("type_label", F.concat(F.lit("kind "), F.col("obj_num").cast("string")))
    found = formats.hint_group_labels(formats.groups_of_page(groups, pages, 0), labels)
    return found.select(F.col("file_id").cast("long").alias("file"), F.col("group").cast("long").alias("group"), "lead_label")


@query("q81_detail_text", "SELECT doc_id, '<<' || chr(10) || '  /Title  (' || coalesce(lang, '') || ')' || chr(10) || '  /Author  (' || coalesce(source, '') || ')' || chr(10) || '>>' AS info, '<<' || chr(10) || '  /Type  /Pages' || chr(10) || '  /Kids  [ 3 0 R ]' || chr(10) || '  /Count  1' || chr(10) || '>>' AS pages FROM documents")
def q81(spark, sf):
    rows = with_doc(graph.detail_text(corpus(spark, sf)))
    return rows.groupBy("doc_id").agg(F.max(F.when(F.col("obj_num") == 6, F.col("detail"))).alias("info"), F.max(F.when(F.col("obj_num") == 2, F.col("detail"))).alias("pages"))


@query("q82_visible_rows", "SELECT doc_id, 10 AS n_visible, 'MediaBox.[3]' AS seventh, 3 AS n_above FROM documents")
def q82(spark, sf):
    nodes = corpus(spark, sf).nodes.where("obj_num = 3")
    opened = nodes.where("depth = 0 or key_path = 'MediaBox'")
    seen = with_doc(graph.visible_rows(nodes, opened)).groupBy("doc_id").agg(F.count("*").alias("n_visible"), F.max(F.when(F.col("row") == 7, F.col("key_path"))).alias("seventh"))
    leaf = nodes.where("key_path = 'Resources.Font.F1'").select("file_id", "path", "obj_num", "node_ix")
    above = with_doc(graph.ancestors(nodes).join(leaf, ["file_id", "path", "obj_num", "node_ix"], "left_semi")).groupBy("doc_id").agg(F.count("*").alias("n_above"))
    return seen.join(above, "doc_id")


@query("q83_file_report", "SELECT doc_id, 15 AS n_lines, 'free          : 1' AS free, '/Size  7' AS size, 'obj 3 0 R  Dictionary  Type=/Page' AS page FROM documents")
def q83(spark, sf):
    rows = with_doc(graph.report(corpus(spark, sf)))
    pick = lambda part, start: F.max(F.when((F.col("part") == part) & F.col("line").startswith(start), F.col("line")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), pick(1, "free").alias("free"), pick(2, "/Size").alias("size"), pick(3, "obj 3 ").alias("page"))


@query(
    "q84_store_names",
    """SELECT doc_id, filename, coalesce(source, 'none') || '_' || CASE WHEN n = 1 THEN 1 ELSE n + 1 END || '.pdf' AS stored_as
       FROM (SELECT doc_id, source, coalesce(source, 'none') || '.pdf' AS filename, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)""",
)
def q84(spark, sf):
    stem = F.coalesce("source", F.lit("none"))
    docs = table(spark, sf, "documents")
    new = docs.select("doc_id", F.concat(stem, F.lit(".pdf")).alias("filename"))
    stored = docs.select(F.explode(F.array(F.concat(stem, F.lit(".pdf")), F.concat(stem, F.lit("_2.pdf")))).alias("filename")).distinct()
    return pdf.store_names(new, stored, "doc_id").select("doc_id", "filename", "stored_as")


def damaged(files: DataFrame) -> DataFrame:
    """Every sixth file as it is; the others with a wrong ``startxref``, length or entry, a cut tail, or bytes before the header."""
    raw = F.decode("content", "ISO-8859-1")
    kind = F.pmod("doc_id", F.lit(6))
    n = F.regexp_extract(raw, r"/Length (\d+)", 1)
    hurt = (
        F.when(kind == 1, F.regexp_replace(raw, r"startxref\n\d+", "startxref\n999999999"))
        .when(kind == 2, F.replace(raw, F.concat(F.lit("/Length "), n), F.concat(F.lit("/Length "), F.lpad(F.lit("1"), F.length(n), F.lit("0")))))
        .when(kind == 3, F.substring_index(raw, "\nxref\n", 1))
        .when(kind == 4, F.concat(F.lit("bytes before the header\n"), raw))
        .when(kind == 5, F.regexp_replace(raw, r"\d{10} 00000 n\r\n(?=trailer)", "0000000003 00000 n\r\n"))
        .otherwise(raw)
    )
    return files.withColumn("content", F.encode(hurt, "ISO-8859-1"))


@query(
    "q85_damaged_files",
    """SELECT doc_id, ['', 'index', 'length', 'index,trailer', 'index', 'entry'][doc_id % 6 + 1] AS repairs, 6 AS n_objects, lang AS title, sha256(text) AS text_sha256 FROM documents""",
)
def q85(spark, sf):
    files = damaged(pdf.generate(table(spark, sf, "documents")))
    path = f"{shared_dir(spark)}/quire/corpus-damaged-{uuid.uuid4().hex}"
    c = Corpus.from_binary(files).save(path)
    facts = with_doc(c.parsed).select("doc_id", F.array_join(F.array_sort(F.array_distinct("repairs.what")), ",").alias("repairs"), F.size("objects").alias("n_objects"))
    title = with_doc(c.nodes.where("obj_num = 6 and key_path = 'Title'")).select("doc_id", F.col("str_v").alias("title"))
    runs = with_doc(text.text_runs(text.content_bytes(c))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("op_ix", "text"))).alias("r"))
    shown = runs.select("doc_id", F.sha2(F.array_join(F.transform("r", lambda x: x["text"]), "\n"), 256).alias("text_sha256"))
    return facts.join(title, "doc_id").join(shown, "doc_id")


@query(
    "q86_inherited_attributes",
    f"""SELECT doc_id, i AS page_ix, CASE WHEN i % 2 = 0 THEN 'MediaBox' ELSE 'CropBox' END AS box, (CASE WHEN i % 2 = 0 THEN 400 ELSE 320 / 3.0 END)::DECIMAL(12, 3)::DOUBLE AS px_width,
              (CASE WHEN i % 2 = 0 THEN 534 ELSE 400 / 3.0 END)::DECIMAL(12, 3)::DOUBLE AS px_height, CASE WHEN i % 3 = 0 THEN 180 ELSE 90 END AS rotate,
              CASE WHEN i % 2 = 0 THEN 'Upper' ELSE 'Lower' END AS font FROM (SELECT doc_id, unnest(range(0, {LINES})) AS i FROM documents)""",
)
def q86(spark, sf):
    c = corpus(spark, sf, "inherit")
    boxes = with_doc(formats.page_boxes(c)).select("doc_id", "obj_num", "box", F.round("px_width", 3).alias("px_width"), F.round("px_height", 3).alias("px_height"), "rotate")
    fonts = with_doc(formats.page_resources(c, "Font")).where("name = 'F1'").select("doc_id", "obj_num", F.col("ref_num").alias("font_num"))
    names = with_doc(formats.fonts(c)).select("doc_id", F.col("obj_num").alias("font_num"), F.col("base_font").alias("font"))
    rows = boxes.join(fonts, ["doc_id", "obj_num"]).join(names, ["doc_id", "font_num"])
    return rows.select("doc_id", ((F.col("obj_num") - 10) / 2).cast("long").alias("page_ix"), "box", "px_width", "px_height", "rotate", "font")


@query(
    "q87_text_in_forms",
    """SELECT doc_id, x::DOUBLE AS x, y::DOUBLE AS y, depth, CASE WHEN depth = 1 THEN lang ELSE source END AS shown
       FROM documents, (VALUES (111, 202, 1), (111, 252, 2), (113, 201, 2), (22, 4, 1), (22, 104, 2), (26, 2, 2)) t(x, y, depth)""",
)
def q87(spark, sf):
    runs = with_doc(forms.text_runs(corpus(spark, sf, "forms")))
    return runs.select("doc_id", "x", "y", (F.size("at") - 1).alias("depth"), F.col("text").alias("shown"))


@query("q88_paths_in_forms", "SELECT doc_id, 5::BIGINT AS n_moves, 5::BIGINT AS n_lines, 2::BIGINT AS n_rectangles, 5::BIGINT AS n_strokes, 2::BIGINT AS n_fills FROM documents")
def q88(spark, sf):
    rows = with_doc(forms.path_counts(corpus(spark, sf, "forms")))
    return rows.select("doc_id", "n_moves", "n_lines", "n_rectangles", "n_strokes", "n_fills")


@query(
    "q89_mixed_codes",
    """SELECT doc_id, s AS shown, 'A' AS second, (72 + 5 * ((n + 1) // 2) + 10 * (n // 2))::DOUBLE AS x2, 'codes of 90ms-RKSJ-H are not known' AS note, (72 + 5 + 5 * ((n + 1) // 2) + 10 * (n // 2))::DOUBLE AS x3, 'AB' AS utf16
       FROM (SELECT doc_id, s, length(s) AS n FROM (SELECT doc_id, regexp_replace(coalesce(source, ''), '[^ -~]', '', 'g') AS s FROM documents))""",
)
def q89(spark, sf):
    c = corpus(spark, sf, "codes")
    runs = with_doc(text.text_runs(text.content_bytes(c), formats.page_fonts(c)))
    r = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("op_ix", "text", "x", "note"))).alias("r")).select("doc_id", *[F.col("r")[i].alias(f"r{i}") for i in range(4)])
    return r.select("doc_id", F.col("r0.text").alias("shown"), F.col("r1.text").alias("second"), F.col("r1.x").alias("x2"), F.col("r2.note").alias("note"), F.col("r3.x").alias("x3"), F.col("r3.text").alias("utf16"))


_PADDED = "rpad_ AS (SELECT doc_id, t || repeat(' ', (greatest(1, (octet_length(encode(t)) + 95) // 96) * 96 - octet_length(encode(t)))::INT) AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


@query(
    "q90_fax_pixels",
    f"WITH {_PADDED} SELECT doc_id, o AS obj_num, (octet_length(encode(p)) // 96)::INT AS height, true AS as_drawn FROM rpad_, (VALUES (4), (5), (7)) t(o)",
)
def q90(spark, sf):
    """Pixels of three CCITT schemes against the bits of the bytes that were drawn."""
    got = with_doc(formats.image_pixels(corpus(spark, sf, "scans"), F.col("obj_num") != 8)).select("doc_id", "obj_num", "height", F.md5("pixels").alias("seen"))
    pair = got.join(table(spark, sf, "documents").select("doc_id", _drawn().alias("drawn")), "doc_id")
    return pair.select("doc_id", "obj_num", "height", "seen", "drawn").mapInArrow(_as_drawn, "doc_id long, obj_num int, height int, as_drawn boolean")


def _as_drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the digest of an image's pixels is that of its third of the bytes drawn, each bit a pixel of 00 or FF."""
    import hashlib

    import numpy as np

    for batch in batches:
        same = []
        for num, seen, drawn in zip(*(batch.column(n).to_pylist() for n in ("obj_num", "seen", "drawn"))):
            third, part = len(drawn) // 3, (4, 5, 7).index(num)
            bits = np.unpackbits(np.frombuffer(drawn, np.uint8, third, part * third))
            same.append(None if seen is None else hashlib.md5((bits * np.uint8(255)).tobytes()).hexdigest() == seen)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("obj_num"), batch.column("height"), pa.array(same, pa.bool_())], names=["doc_id", "obj_num", "height", "as_drawn"])


@query(
    "q91_jpeg_pixels",
    f"WITH {_PADDED} SELECT doc_id, octet_length(encode(p))::INT AS n_pixels, 0 AS n_beyond_one FROM rpad_",
)
def q91(spark, sf):
    """Grey pixels of JPEG pictures against the bytes that were drawn."""
    got = with_doc(formats.image_pixels(corpus(spark, sf, "scans"), F.col("obj_num") == 8)).select("doc_id", F.col("pixels").alias("seen"))
    pair = got.join(table(spark, sf, "documents").select("doc_id", _drawn().alias("drawn")), "doc_id")
    return pair.select("doc_id", "seen", "drawn").mapInArrow(_beyond_one, "doc_id long, n_pixels int, n_beyond_one int")


def _drawn() -> Column:
    """What ``scans`` draws of a ``text``: its bytes, and spaces up to whole rows of three images."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return F.rpad(raw, F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / 96)).cast("int") * 96, F.lit(b" "))


def _beyond_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples of each picture ``doc_id, seen, drawn``, and how many are off by more than one; one that the other side lacks counts too."""
    import numpy as np

    for batch in batches:
        n, beyond = [], []
        for pair in zip(*(c.to_pylist() for c in batch.columns[1:])):
            if None in pair:
                n.append(None)
                beyond.append(None)
                continue
            a, b = (np.frombuffer(x, np.uint8).astype(np.int16) for x in pair)
            both = min(len(a), len(b))
            n.append(max(len(a), len(b)))
            beyond.append(n[-1] - both + int((np.abs(a[:both] - b[:both]) > 1).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(beyond, pa.int32())], names=["doc_id", "n_pixels", "n_beyond_one"])


def _edits(docs: DataFrame, values: dict, lang: str | None = None) -> DataFrame:
    """The information dictionary anew, as an edit of the exploded files of ``docs``."""
    rows = docs if lang is None else docs.where(F.col("lang") == lang)
    source = F.lit(json.dumps({"_obj": "6 0", "value": values})).cast("binary")
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.lit("objects/00006_0.pdfjson").alias("name"), source.alias("data"))


@query(
    "q92_changed_values",
    """SELECT doc_id, 6 AS obj_num, p AS key_path, c AS change FROM documents, (VALUES ('Title', 'changed'), ('Author', 'removed'), ('Keep', 'added')) t(p, c) WHERE lang = 'de'""",
)
def q92(spark, sf):
    docs, before = table(spark, sf, "documents"), corpus(spark, sf)
    n = before.buckets
    old = written(versions.begin(pdf.generate(docs, then=pdfx.exploding(), tasks=n)), "versions")
    new = old.union(versions.commit(old, _edits(docs, {"Title": "edited", "Keep": [1, {"Deep": True}]}, "de")))
    after = Corpus.from_binary(pdfx.link(versions.as_of(new, tasks=n))).by_path("edited", n)
    return with_doc(versions.diff(before.nodes.where("obj_num >= 0"), after.nodes.where("obj_num >= 0"), n)).select("doc_id", "obj_num", "key_path", "change")


@query(
    "q93_versions_read_back",
    """SELECT doc_id, v::BIGINT AS version, CASE WHEN v = 0 THEN 'as written' WHEN v = 2 AND lang = 'fr' THEN 'second' ELSE 'first' END AS title, true AS sound
       FROM documents, (VALUES (0), (1), (2), (3)) t(v)""",
)
def q93(spark, sf):
    """Title as of each version: an edit of all files, one of some, and its undo; version 0 byte for byte."""
    docs = table(spark, sf, "documents")
    n = pdf.tasks_of(docs)
    # Each version adds its own rows; those before it are not written again.
    store = written(versions.begin(pdf.generate(docs, then=pdfx.exploding(), tasks=n)), "versions")
    store = store.union(written(versions.commit(store, _edits(docs, {"Title": "first"})), "versions"))
    store = store.union(written(versions.commit(store, _edits(docs, {"Title": "second"}, "fr")), "versions"))
    store = store.union(written(versions.restore(store, 1), "versions"))
    was = pdf.generate(docs, tasks=n).select("path", F.sha2("content", 256).alias("was"))
    out = None
    for v in range(4):
        # Linked and read once; a file's id is the digest of its bytes, and one that could not be linked has no title.
        back = Corpus.from_binary(pdfx.link(versions.as_of(store, v, n))).nodes.where("obj_num = 6 and key_path = 'Title'")
        back = back.select("path", "file_id", F.when(F.lit(v == 0), "as written").otherwise(F.col("str_v")).alias("title"))
        rows = back.withColumn("sound", F.lit(True)) if v else back.join(was, "path").withColumn("sound", F.col("file_id") == F.col("was"))
        part = with_doc(rows).select("doc_id", F.lit(v).cast("long").alias("version"), "title", "sound")
        out = part if out is None else out.union(part)
    return out


_PHRASES = ["of the", "de la", "in der", "the", "no such words here"]
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


@query(
    "q94_phrase_search",
    " UNION ALL ".join(
        f"""SELECT doc_id, '{p}' AS phrase, n FROM (SELECT doc_id, len(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f"w[i + {k}] = '{t}'" for k, t in enumerate(p.split()))})) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) WHERE n > 0"""
        for p in _PHRASES),
)
def q94(spark, sf):
    """Occurrences of phrases in the pages of files, from the index of their texts alone."""
    index = f"{shared_dir(spark)}/quire/index-{uuid.uuid4().hex}"
    search.write(search.page_texts(text.text_runs(text.content_bytes(corpus(spark, sf)))), index)
    rows = search.open_index(spark, index)
    out = None
    for p in _PHRASES:
        part = search.phrases(rows, p).select(F.substring_index("doc", "#", 1).alias("path"), F.lit(p).alias("phrase"))
        out = part if out is None else out.union(part)
    return with_doc(out).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


#: Bytes of a text that the images of the ``rich`` layout are made of, as ``h`` in hexadecimal, ``m`` of them in threes.
_PART = """part AS (SELECT doc_id, n, greatest(3, least(60, n) // 3 * 3) AS m, left(h || '202020', (2 * greatest(3, least(60, n) // 3 * 3))::INT) AS h
              FROM (SELECT doc_id, octet_length(encode(t)) AS n, left(hex(encode(t)), 120) AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))"""


@query(
    "q95_icc_profiles",
    """SELECT doc_id, coalesce(source, '') AS description, '2.4' AS version, 'RGB' AS color_space, (0.5 + length(coalesce(lang, '')) / 64)::DOUBLE AS white_x, 4 AS n_tags, 4 AS n_padding,
              'rTRC / gTRC' AS shared_curve, '255,255,255' AS preview FROM documents""",
)
def q95(spark, sf):
    c = corpus(spark, sf, "rich")
    # Bradford-adapted, the D50 white is white.
    d50 = formats.srgb_preview(F.lit(0.9642), F.lit(1.0), F.lit(0.8249))
    head = with_doc(formats.icc_headers(c)).select("doc_id", "description", "version", "color_space", F.col("white_point")[0].alias("white_x"), F.concat_ws(",", d50).alias("preview"))
    tags = with_doc(formats.icc_tags(c)).groupBy("doc_id").agg(F.count("*").alias("n_tags"))
    parts = with_doc(formats.icc_segments(c)).groupBy("doc_id").agg(F.sum(F.when(F.col("label") == "Padding", F.col("size"))).alias("n_padding"), F.max(F.when(F.col("label").contains("/"), F.col("label"))).alias("shared_curve"))
    return head.join(tags, "doc_id").join(parts, "doc_id")


@query(
    "q96_font_programs",
    """SELECT doc_id, t.tag AS tag, CASE t.k WHEN 0 THEN 60 WHEN 1 THEN 60 + (n + 3) // 4 * 4 ELSE 116 + (n + 3) // 4 * 4 END AS "offset", CASE t.k WHEN 0 THEN n WHEN 1 THEN 54 ELSE 6 END AS length, 6 AS n_completed
       FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), (VALUES (0, 'glyf'), (1, 'head'), (2, 'maxp')) t(k, tag)""",
)
def q96(spark, sf):
    c = corpus(spark, sf, "rich")
    full = with_doc(formats.ttf_files(c)).select("doc_id", F.conv(F.hex(F.substring("font", 5, 2)), 16, 10).cast("int").alias("n_completed"))
    return with_doc(formats.ttf_tables(c)).select("doc_id", "tag", "offset", "length").join(full, "doc_id")


@query(
    "q97_font_dictionaries",
    """SELECT doc_id, octet_length(encode(coalesce(text, '')))::DOUBLE AS ascent, CASE WHEN n % 2 = 1 THEN 'Symbolic,Italic' ELSE 'Symbolic' END AS flags, '0.0,-200.0,1000.0,900.0' AS bbox, 'Adobe-Identity-' || n AS collection,
              750.0::DOUBLE AS default_width, n AS n_glyphs, n * (n + 1) AS sum_gids, n + 1 AS n_present, greatest(1, n) AS n_codes, 'éß€' AS shown
       FROM (SELECT doc_id, text, length(coalesce(source, '')) AS n FROM documents)""",
)
def q97(spark, sf):
    c = corpus(spark, sf, "rich")
    d = with_doc(formats.font_descriptors(c)).select("doc_id", "ascent", F.concat_ws(",", "flags").alias("flags"), F.concat_ws(",", "bbox").alias("bbox"))
    t = with_doc(formats.type0_fonts(c)).select("doc_id", F.concat_ws("-", "cid_registry", "cid_ordering", "cid_supplement").alias("collection"), "default_width")
    label = lambda name: c.streams.join(graph.classify(c).where(F.col("type_label") == name), ["file_id", "path", "obj_num"], "left_semi").select("file_id", "path", "obj_num", "stream_decoded")
    g = c.files.select("file_id", "path").join(formats.cid_map(label("CID-to-GID Map")), ["file_id", "path"], "left")
    g = with_doc(g).groupBy("doc_id").agg(F.count("gid").alias("n_glyphs"), F.coalesce(F.sum("gid"), F.lit(0)).alias("sum_gids"))
    s = with_doc(formats.cid_sets(label("CID Set"))).select("doc_id", F.col("present_count").alias("n_present"))
    m = with_doc(formats.cmaps(c)).groupBy("doc_id").agg(F.count("*").alias("n_codes"))
    r = with_doc(text.text_runs(text.content_bytes(c), formats.page_fonts(c))).select("doc_id", F.col("text").alias("shown"))
    return d.join(t, "doc_id").join(g, "doc_id").join(s, "doc_id").join(m, "doc_id").join(r, "doc_id")


@query(
    "q98_image_facts",
    f"""WITH {_PART} SELECT doc_id, o AS obj_num, CASE o WHEN 20 THEN 2 * m WHEN 21 THEN m // 3 WHEN 22 THEN m ELSE 8 * m END AS width, b AS bits, p AS predictor_name, f AS fax, CASE WHEN o = 22 THEN 'SOI,DQT,SOF0,DHT,SOS,,EOI' END AS segments,
              CASE WHEN o = 20 THEN true WHEN o = 21 THEN false END AS flipped
        FROM part, (VALUES (20, 4, 'None', NULL), (21, 8, 'TIFF 2', NULL), (22, 8, 'None', NULL), (23, 1, 'None', 'G4')) t(o, b, p, f)""",
)
def q98(spark, sf):
    c = corpus(spark, sf, "rich")
    rows = with_doc(formats.images(c)).select("doc_id", "obj_num", "width", F.col("bits_per_component").alias("bits"), "predictor_name", F.col("compression_short").alias("fax"))
    segments = with_doc(formats.jpeg_segments(c)).groupBy("doc_id", "obj_num").agg(F.array_sort(F.collect_list(F.struct("offset", F.col("marker"), "name", "is_scan"))).alias("s"))
    segments = segments.select("doc_id", "obj_num", F.array_join(F.transform("s", lambda x: F.when(x["is_scan"], "").otherwise(x["name"])), ",").alias("segments"))
    names = with_doc(formats.page_resources(c, "XObject")).select("doc_id", "name", F.col("ref_num").alias("obj_num"))
    placed = with_doc(text.image_placements(text.content_bytes(c))).select("doc_id", "name", "flipped").join(names, ["doc_id", "name"]).select("doc_id", "obj_num", "flipped")
    return rows.join(segments, ["doc_id", "obj_num"], "left").join(placed, ["doc_id", "obj_num"], "left")


@query(
    "q99_sample_pixels",
    f"""WITH {_PART} SELECT doc_id, o AS obj_num, (CASE o WHEN 20 THEN 2 * m WHEN 21 THEN m // 3 ELSE 8 * m END)::INT AS width, CASE o WHEN 20 THEN upper(regexp_replace(h, '(.)', '\\1\\1', 'g')) WHEN 21 THEN upper(h) END AS pixels,
              CASE WHEN o = 23 THEN upper(h) END AS packed, CASE WHEN o = 23 THEN 6 ELSE CASE WHEN o = 21 THEN 2 ELSE 0 END END AS png_kind FROM part, (VALUES (20), (21), (23)) t(o)""",
)
def q99(spark, sf):
    """Every sample of images with four bits, with differences, and in CCITT, and the kinds of their PNG files."""
    c = corpus(spark, sf, "rich")
    rows = with_doc(formats.image_pixels(c, F.col("obj_num") != 22))
    files = with_doc(formats.image_files(c)).select("doc_id", "obj_num", F.conv(F.hex(F.substring("data", 26, 1)), 16, 10).cast("int").alias("png_kind"))
    fax = F.col("obj_num") == 23
    # Ones are black on paper and dark in pixels where they are set; as drawn here ones are black and BlackIs1 keeps them ones.
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.hex("pixels"), "FF", "1"), "00", "0"), "(.{4})", "$1 ")
    for i in range(16):
        digits = F.replace(digits, F.lit(f"{i:04b} "), F.lit(f"{i:X}"))
    return rows.join(files, ["doc_id", "obj_num"]).select("doc_id", "obj_num", "width", F.when(~fax, F.hex("pixels")).alias("pixels"), F.when(fax, digits).alias("packed"), "png_kind")


@query("q100_hidden_text", "SELECT doc_id, true AS invisible, 2::BIGINT AS n_images FROM documents")
def q100(spark, sf):
    rows = ops(spark, sf, "rich")
    n = with_doc(rows).groupBy("doc_id").agg(F.count_if(F.col("op") == "Do").alias("n_images"))
    return with_doc(text.has_invisible_text(rows)).select("doc_id", "invisible").join(n, "doc_id")


_LINED = f"""lined AS (SELECT doc_id, i, n, length(l) AS k FROM (SELECT doc_id, unnest(range(0, {LINES})) AS i, {LINES} AS n, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents))"""


@query(
    "q101_hinted_pages",
    f"""WITH {_LINED} SELECT doc_id, i::INT AS page, 2 + i % 4 AS nobjects, 50 + k AS page_length, i % 2 AS nshared, CASE WHEN i % 2 = 1 THEN (i % 3)::VARCHAR ELSE '' END AS shared_ids,
              (CASE WHEN i = 0 THEN 0 ELSE coalesce(sum(CASE WHEN i > 0 THEN 50 + k ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END)::BIGINT AS behind_first FROM lined""",
)
def q101(spark, sf):
    c = corpus(spark, sf, "linear")
    rows = formats.hint_rows(formats.hint_streams(c))
    p = formats.linearization(c).select("file_id", "path", "hint_offset", "hint_length", "end_of_first_page")
    pages = rows.join(p, ["file_id", "path"]).withColumn("dict_offset", F.lit(None).cast("long")).withColumn("first_page_offset", F.lit(0).cast("long"))
    placed = layout.section_offsets(pages)
    behind = F.when(F.col("page") == 0, F.col("section_offset")).otherwise(F.col("section_offset") - F.col("end_of_first_page"))
    return with_doc(placed).select("doc_id", "page", "nobjects", "page_length", "nshared", F.concat_ws(",", F.col("shared_ids").cast("array<string>")).alias("shared_ids"), behind.cast("long").alias("behind_first"))


@query(
    "q102_linearized_files",
    f"""SELECT doc_id, true AS linearized, {LINES} AS num_pages, 6 AS first_page_obj, 'Linearization Dictionary' AS label_1, 'Linearization Hint Stream' AS label_3, '6:2:11:first_page,16:1:12:rest,17:3:13:rest' AS shared_groups, true AS whole FROM documents""",
)
def q102(spark, sf):
    c = corpus(spark, sf, "linear")
    facts = with_doc(formats.linearization(c).join(c.files.select("file_id", "path", "length", "linearized"), ["file_id", "path"]))
    facts = facts.select("doc_id", "linearized", "num_pages", "first_page_obj", (F.col("file_length") == F.col("length")).alias("whole"))
    pick = lambda n: F.max(F.when(F.col("obj_num") == n, F.col("type_label"))).alias(f"label_{n}")
    labels = with_doc(graph.classify(c)).groupBy("doc_id").agg(pick(1), pick(3))
    groups = with_doc(formats.hint_rows(formats.hint_streams(c), "shared_groups")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group", F.concat_ws(":", "first_obj", "nobjects", "group_length", "section").alias("g")))).alias("g"))
    return facts.join(labels, "doc_id").join(groups.select("doc_id", F.array_join(F.transform("g", lambda x: x["g"]), ",").alias("shared_groups")), "doc_id")


@query(
    "q103_annotated_dumps",
    """SELECT doc_id, 'Header' AS first_label, length(coalesce(source, '')) + 1 + 12 AS n_desc,
              '=== Padding ===' || chr(10) || '    0x00C4 – 0x00C7  (4 bytes)' || chr(10) || '00C4: 00 00 00 00' AS padding, 6 AS n_sections FROM documents""",
)
def q103(spark, sf):
    c = corpus(spark, sf, "rich")
    streams = c.streams.join(formats.icc_segments(c).select("file_id", "path", "obj_num").distinct(), ["file_id", "path", "obj_num"], "left_semi")
    rows = with_doc(text.annotated_dump(formats.icc_segments(c), streams))
    pick = lambda pattern: F.regexp_extract("dump", pattern, 1)
    return rows.select(
        "doc_id", pick(r"^=== (\w+) ===").alias("first_label"), pick(r"(?s)=== desc ===\n[^\n]*\((\d+) bytes").cast("int").alias("n_desc"),
        pick(r"(=== Padding ===\n[^\n]*\n[^\n]*)").alias("padding"), F.regexp_count("dump", F.lit("=== [^=]+ ===")).alias("n_sections"))


@query(
    "q104_described_operators",
    f"""SELECT doc_id, op, CASE op WHEN 'BT' THEN 'Begin text object' WHEN 'ET' THEN 'End text object' WHEN 'Tf' THEN 'Select font and size' WHEN 'Td' THEN 'Move text position' WHEN 'Tj' THEN 'Show text string' ELSE 'Move to start of next line' END AS description,
              CASE WHEN op IN ('Td', 'T*') THEN 'Text positioning' WHEN op = 'Tj' THEN 'Text show' ELSE 'Text state' END AS label, CASE WHEN op IN ('Td', 'T*') THEN 'text-pos' WHEN op = 'Tj' THEN 'text-show' ELSE 'text-state' END AS color,
              CASE WHEN op IN ('Tj', 'T*') THEN {LINES} ELSE 1 END AS n FROM documents, (VALUES ('BT'), ('ET'), ('Tf'), ('Td'), ('Tj'), ('T*')) t(op)""",
)
def q104(spark, sf):
    return with_doc(text.described(ops(spark, sf))).groupBy("doc_id", "op", "description", "label", "color").agg(F.count("*").alias("n"))


@query("q105_relink_tables", "SELECT doc_id, true AS as_linked_whole, lang = 'de' AS edited FROM documents")
def q105(spark, sf):
    """Files linked from rows of objects against files linked each in one piece: unchanged ones, and edited ones with a new table."""
    manifest, files = _edited(spark, sf, "lay1", "lang = 'de'")
    new = relink.link(manifest, files).select("path", F.md5("content").alias("new"))
    old = pdfx.link(files).select("path", F.md5("content").alias("old"))
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    return with_doc(new.join(old, "path")).join(langs, "doc_id").select("doc_id", (F.col("new") == F.col("old")).alias("as_linked_whole"), (F.col("lang") == "de").alias("edited"))


@query("q106_relink_streams", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'edited' ELSE lang END AS title, CASE WHEN lang = 'de' THEN 'someone' ELSE source END AS author, 2 AS n_compressed, '' AS repairs FROM documents")
def q106(spark, sf):
    """Files with object streams and an index stream, linked from rows and read again."""
    manifest, files = _edited(spark, sf, "lay2", "lang = 'de'")
    c = Corpus(written(Corpus.from_binary(relink.link(manifest, files)).parsed, "relinked"))
    facts = with_doc(c.parsed).select("doc_id", F.array_join("repairs.what", ",").alias("repairs"))
    return _info(c).join(with_doc(graph.entry_counts(c)).select("doc_id", "n_compressed"), "doc_id").join(facts, "doc_id")
