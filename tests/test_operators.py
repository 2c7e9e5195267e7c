"""Operators over small corpora written for them."""

import struct

import pytest
from pyspark.sql import functions as F

from quire.functions import write as W
from quire.functions.lexer import Value
from quire.operators import formats, graph, layout, pdfx, text
from quire.operators.corpus import Corpus
from tests.test_formats import profile


def files(spark, *contents):
    return spark.createDataFrame([(f"{i}.pdf", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def name(n):
    return W.wrap(n)


@pytest.fixture(scope="module")
def rich(spark):
    """One page with an array of contents, fonts, an indexed image, an ICC profile and a character map."""
    ref, d = W.ref, W.dictionary
    cmap = b"1 beginbfchar <01> <0041> endbfchar"
    objects = [
        (1, d(Type="Catalog", Pages=ref(2), PageLabels=ref(20))),
        (2, d(Type="Pages", Kids=[ref(3), ref(4)], Count=2)),
        (3, d(Type="Page", Parent=ref(2), Contents=ref(5), Resources=ref(8), CropBox=[0, 0, 72, 144], MediaBox=[0, 0, 612, 792], Thumb=ref(19))),
        (4, d(Type="Page", Parent=ref(2), Contents=[ref(6), ref(7)], Kids=[ref(2)])),
        (5, Value("Array", [ref(6), ref(7)])),
        (6, W.stream(b"BT /F1 12 Tf (a) Tj ET")),
        (7, W.stream(b"q 1 0 0 -1 0 0 cm /Im Do Q 3 Tr")),
        (8, d(Font=ref(9), XObject=d(Im=ref(12)))),
        (9, d(F1=ref(10))),
        (10, d(Type="Font", Subtype="TrueType", BaseFont="ABCDEF+Arial-BoldMT", FirstChar=32, LastChar=34, Widths=[250, 333.5, 400], FontDescriptor=ref(11), ToUnicode=ref(15),
               Encoding=d(Differences=[65, name("a"), name("b"), 70, name("c")]))),
        (11, d(Type="FontDescriptor", FontName="Arial", Flags=33, Ascent=900, StemV=80.5, FontBBox=[0, -200, 1000, 900], FontFile2=ref(16), CIDSet=ref(17))),
        (12, W.stream(b"\x00\x01", Type="XObject", Subtype="Image", Width=2, Height=1, BitsPerComponent=8, ColorSpace=ref(13))),
        (13, Value("Array", [name("Indexed"), name("DeviceRGB"), W.wrap(1), ref(14)])),
        (14, W.stream(bytes([255, 0, 0, 0, 0, 16]))),
        (15, W.stream(cmap)),
        (16, W.stream(b"font")),
        (17, W.stream(b"\x81\x00")),
        (18, Value("Array", [name("ICCBased"), ref(21)])),
        (19, W.stream(b"t")),
        (20, d(Nums=[0, ref(22)])),
        (21, W.stream(profile())),
        (22, d(S="D")),
        (23, Value("Array", [name("PDF"), name("Text")])),
        (24, d(Type="Font", Subtype="Type0", BaseFont="X", DescendantFonts=[ref(25)])),
        (25, d(Type="Font", Subtype="CIDFontType2", BaseFont="Y", CIDSystemInfo=d(Registry=Value("LiteralString", "Adobe"), Ordering=Value("LiteralString", "Identity"), Supplement=0), CIDToGIDMap=ref(26))),
        (26, W.stream(struct.pack(">4H", 0, 3, 0, 7))),
        (27, W.stream(b"x", Length1=ref(28))),
        (28, W.wrap(5)),
    ]
    df = files(spark, W.assemble(objects, {"Root": ref(1)}), b"broken")
    from quire.operators.corpus import Corpus as C

    return C(C.from_binary(df).parsed.cache())


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_broken_file_is_one_error_row(rich):
    assert [r.error is None for r in rich.files.orderBy("path").collect()] == [True, False]


def test_labels(rich):
    got = dict(rows(graph.classify(rich), "obj_num", "type_label"))
    assert got == {
        1: "Catalog", 2: "Pages Tree", 3: "Page", 4: "Page", 5: "Content Stream (Array)", 6: "Content Stream", 7: "Content Stream", 8: "Resource Dictionary", 9: "Font Resource Map", 10: "Font (TrueType)",
        11: "Font Descriptor", 12: "Image (Flate)", 13: "Color Space (Indexed)", 14: "Color Palette", 15: "ToUnicode CMap", 16: "Font File (TrueType)", 17: "CID Set", 18: "Color Space (ICCBased)",
        19: "Page Thumbnail", 20: "Page Labels Number Tree", 21: "ICC Profile", 22: "Page Label", 23: "Procedure Set", 24: "Font (Type0)", 25: "Font (CIDFontType2)", 26: "CID-to-GID Map", 27: "Stream", 28: "Integer",
    }


def test_capabilities(rich):
    got = graph.capabilities(rich)
    assert {r.obj_num for r in got.where("is_content_stream").collect()} == {5, 6, 7}
    assert {r.obj_num for r in got.where("is_image").collect()} == {12, 19}
    assert {r.obj_num for r in got.where("is_font").collect()} == {10}
    assert {r.obj_num for r in got.where("is_palette or is_icc_profile or is_cid_set or is_tounicode or is_ttf or is_cid_to_gid_map").collect()} == {14, 21, 17, 15, 16, 26}


def test_pages(rich):
    assert rows(graph.page_order(rich), "obj_num", "page_ix") == {(3, 0), (4, 1)}
    assert rows(graph.owning_pages(rich), "obj_num", "page_num") >= {(6, 3), (7, 3), (6, 4), (7, 4)}
    assert rows(formats.page_boxes(rich), "obj_num", "box", "px_width", "px_height") == {(3, "CropBox", 96.0, 192.0)}
    assert rows(formats.page_resources(rich, "XObject"), "obj_num", "name", "ref_num") == {(3, "Im", 12)}


def test_contents_are_joined_in_order(rich):
    pages = text.content_bytes(rich)
    assert {bytes(r.stream_decoded) for r in pages.collect()} == {b"BT /F1 12 Tf (a) Tj ET\nq 1 0 0 -1 0 0 cm /Im Do Q 3 Tr"}
    ops = text.content_ops(pages)
    assert rows(text.category_counts(ops).where("obj_num = 3"), "category", "n_ops") == {("text_state", 4), ("text_show", 1), ("gstate", 3), ("xobject", 1)}
    assert text.has_invisible_text(ops).where("invisible").count() == 2
    assert rows(text.image_placements(pages), "name", "flipped") == {("Im", True)}
    assert rows(text.text_runs(pages), "text", "font") == {("a", "F1")}


def test_fonts(rich):
    r = formats.fonts(rich).first()
    assert (r.base_font, r.first_char, r.widths, r.is_embedded, r.font_descriptor_num, r.to_unicode_num) == ("ABCDEF+Arial-BoldMT", 32, [250.0, 333.5, 400.0], True, 11, 15)
    assert rows(formats.encoding_differences(rich), "code", "glyph") == {(65, "a"), (66, "b"), (70, "c")}
    f = formats.font_descriptors(rich).first()
    assert (f.flags, f.bbox, f.stem_v, f.font_file_num) == (["FixedPitch", "Nonsymbolic"], [0.0, -200.0, 1000.0, 900.0], 80.5, 16)
    t = formats.type0_fonts(rich).first()
    assert (t.descendant_num, t.cid_subtype, t.cid_registry, t.cid_ordering, t.default_width) == (25, "CIDFontType2", "Adobe", "Identity", 1000.0)
    named = rich.parsed.sparkSession.createDataFrame([("ABCDEF+TimesNewRoman-BoldItalic",), ("Courier",), ("Arial",)], "n string")
    assert [tuple(x) for x in named.select(text.font_family(F.col("n")), text.font_style(F.col("n"))).collect()] == [("serif", "italic bold"), ("monospace", ""), ("sans-serif", "")]


def test_formats(rich):
    assert rows(formats.cmaps(rich), "src_int", "char") == {(1, "A")}
    assert rows(formats.palettes(rich), "index", "hex", "dark_bg") == {(0, "#ff0000", True), (1, "#000010", True)}
    assert rows(graph.palette_references(rich), "obj_num") == {(14,)}
    assert rows(formats.icc_headers(rich), "description", "pcs") == {("name", "XYZ")} and formats.icc_tags(rich).count() == 6 and formats.icc_segments(rich).count() == 8
    assert rows(formats.cid_map(rich.streams.where("obj_num = 26")), "cid", "gid") == {(1, 3), (3, 7)}
    assert rows(formats.cid_sets(rich.streams.where("obj_num = 17")), "total_slots", "present_count", "last_cid", "coverage_hex") == {(16, 2, 7, "8100")}
    assert rows(formats.images(rich), "width", "height", "filter", "raw_size", "decoded_size", "predictor_name") == {(2, 1, "FlateDecode", 10, 2, "None")}


def test_value_tree_and_links(rich, spark):
    got = dict(rows(graph.value_tree(rich).where("obj_num = 12 and depth <= 1"), "key_path", "brief"))
    assert got["Width"] == "2" and got["Subtype"] == "/Image" and got["ColorSpace"] == "13 0 R"
    assert spark.range(1).select(graph.link_targets(F.lit("see 12 0 R and 3 1 R"))).first()[0] == [12, 3]
    assert graph.document_tree(rich).where("section = 'Body'").count() == 28


def test_sizes_account_for_every_byte(rich):
    r = layout.object_sizes(rich).groupBy("path").agg(F.sum("size").alias("s"), F.min("offset").alias("o"), F.max("length").alias("n")).first()
    assert r.s == r.n - r.o
    assert layout.export_bounds(rich).where("end is null or end <= offset").count() == 0


def test_range_join_equals_the_plain_predicate(spark):
    p = spark.range(0, 200).select(F.col("id").alias("at"))
    i = spark.createDataFrame([(1, 0, 10), (2, 5, 5), (3, 8, 160), (4, 199, 500)], "k int, b long, e long")
    want = {(x, k) for x in range(200) for k, b, e in [(1, 0, 10), (2, 5, 5), (3, 8, 160), (4, 199, 500)] if b <= x < e}
    got = layout.range_join(p, i, "at", "b", "e", 16)
    assert rows(got, "at", "k") == want and got.count() == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_layout_helpers(spark):
    s = spark.createDataFrame([("f", "p", n, 10, d, 100, 50, 20, 400) for n, d in ((0, 1), (1, None), (2, 9))],
                              "file_id string, path string, page int, page_length long, dict_offset long, first_page_offset long, hint_offset long, hint_length long, end_of_first_page long")
    assert [r.section_offset for r in layout.section_offsets(s).orderBy("page").collect()] == [120, 400, 410]
    known = layout.section_offsets(s.fillna({"dict_offset": 5}))
    assert [r.section_offset for r in known.orderBy("page").collect()] == [120, 5, 9]
    g = spark.createDataFrame([("x", 0, 5), ("x", 3, 9), ("x", 12, 13), ("y", 1, 2)], "k string, b int, e int")
    assert rows(layout.gaps(g, ["k"], "b", "e"), "k", "gap_begin", "gap_end") == {("x", 9, 12)}
    assert rows(layout.absent(spark.createDataFrame([(1,), (3,)], "n int"), "n", 0, 5), "n") == {(0,), (2,), (4,)}
    labels = spark.createDataFrame([(5,), (2048,), (3 << 20,)], "n long").select(layout.byte_label(F.col("n"))).collect()
    assert [r[0] for r in labels] == ["5 B", "2.0 KB", "3.00 MB"]
    t = layout.running_total(spark.range(10).select("id", F.lit(2).alias("v")), "id", "v", 4)
    assert rows(t, "id", "begin") == {(i, 2 * i) for i in range(10)}


def test_search_and_sort(spark):
    m = spark.createDataFrame([(0, "0041", "A", 65), (1, "0042", "B", 66)], "seq int, src_hex string, char string, code_point int")
    assert rows(layout.search_map(m, "B"), "seq") == {(1,)} and rows(layout.search_map(m, "65"), "seq") == {(0,)} and layout.search_map(m, "004").count() == 2
    e = spark.createDataFrame([(1, None, "in_use", "b"), (2, 5, "free", "A"), (3, 1, "in_use", "a")], "obj_num int, size int, etype string, kind string")
    assert [r.obj_num for r in layout.sort_entries(e, "size").collect()] == [1, 3, 2]
    assert [r.obj_num for r in layout.sort_entries(e, "kind").collect()] == [3, 2, 1]
    assert [r.obj_num for r in layout.sort_entries(e, "size", True, "in_use").collect()] == [3, 1]


def test_text_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.hex_dump(F.lit(b"ABC\x00"))) == "00000000  41 42 43 00" + " " * 36 + "  ABC."
    assert one(text.stream_faults(F.lit("BT (Q) q"))) == ["BT/ET unbalanced", "q/Q unbalanced"]
    assert one(text.edit_intent(F.lit("please Replace it"))) == "edit" and one(text.edit_intent(F.lit("what is it"))) == "chat"
    assert one(text.reply_block(F.lit("x\n```pdf\nBT\n```\ny"))) == "BT\n" and one(text.reply_block(F.lit("```\nBT"))) == "BT"
    assert one(text.printable(F.lit(b"a\r\n\x01"))) == "a\n."
    assert one(text.is_content(F.lit(b"q BT /F 1 Tf ET"))) and not one(text.is_content(F.lit(b"plain words")))
    assert one(formats.srgb_preview(F.lit(0.9642), F.lit(1.0), F.lit(0.8249))) == [255, 255, 255]
    assert [one(text.renderable(F.lit(x))) for x in (31, 32, 0xD800, 0xFFFD)] == [False, True, False, False]


def test_change_detection_and_link(spark):
    f = files(spark, W.layout("lay1", "x", "en", "s"), b"broken")
    m, e = pdfx.manifest(f), pdfx.explode_files(f)
    assert m.where("error is not null").count() == 1
    good = e.where("error is null")
    assert pdfx.changes(m.where("error is null"), good).where("modified").count() == 0
    linked = pdfx.link(good).first()
    assert linked.error is None and bytes(linked.content) == W.layout("lay1", "x", "en", "s")


def test_resolution_keeps_dangling_references(spark):
    c = Corpus.from_binary(files(spark, W.assemble([(1, W.dictionary(Type="Catalog", X=W.ref(99)))], {"Root": W.ref(1)})))
    assert rows(graph.resolve(c.nodes, c.objects), "ref_num", "target_type") == {(99, None), (1, "Catalog")}


def test_linearized_hint_stream_label(spark):
    hint = W.stream(b"\0" * 60)
    # The dictionary names the hint stream's place in the file.
    def make(at):
        return W.assemble([(1, W.dictionary(Linearized=1, H=[at, 10], N=1, O=3, E=9)), (2, hint), (3, W.dictionary(Type="Catalog"))], {"Root": W.ref(3)})

    data = make(100000)
    at = data.index(b"2 0 obj")
    data = make(at) if make(at).index(b"2 0 obj") == at else make(make(at).index(b"2 0 obj"))
    c = Corpus.from_binary(files(spark, data))
    assert dict(rows(graph.classify(c), "obj_num", "type_label"))[2] == "Linearization Hint Stream"
    assert formats.linearization(c).first().num_pages == 1


def test_pages_a_hundred_levels_deep(spark):
    """A chain of page-tree nodes, each with one page and the next node; the last names the first again."""
    d, ref, n = W.dictionary, W.ref, 100
    objects = [(1, d(Type="Catalog", Pages=ref(2)))]
    for i in range(n):
        objects.append((2 + 2 * i, d(Type="Pages", Kids=[ref(3 + 2 * i), ref(4 + 2 * i if i < n - 1 else 2)], Count=n - i)))
        objects.append((3 + 2 * i, d(Type="Page", Parent=ref(2 + 2 * i))))
    c = Corpus.from_binary(files(spark, W.assemble(objects, {"Root": ref(1)})))
    got = [(r.page_ix, r.obj_num) for r in graph.page_order(c).orderBy("page_ix").collect()]
    assert got == [(i, 3 + 2 * i) for i in range(n)]


def test_changes_tell_deleted_and_added_objects(spark):
    one = files(spark, W.layout("lay1", "text", "en", "s"))
    out = pdfx.explode_files(one).select("path", "name", "data").where("name <> 'objects/00005_0.pdfjson'")
    new = spark.createDataFrame([("0.pdf", "objects/00042_0.pdfjson", bytearray(b"{}"))], out.schema)
    got = {r.num: r.status for r in pdfx.changes(pdfx.manifest(one), out.union(new)).collect()}
    assert got == {1: "same", 2: "same", 3: "same", 4: "same", 5: "deleted", 6: "same", 42: "added"}


def test_shared_folder_has_to_be_named_on_a_cluster():
    from types import SimpleNamespace

    from quire.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)


def test_image_files(rich):
    import zlib

    (got,) = formats.image_files(rich).where("obj_num = 12").collect()
    data = bytes(got.data)
    assert (got.format, got.error, data[:8]) == ("png", None, b"\x89PNG\r\n\x1a\n")
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")]) == bytes([0, 255, 0, 0, 0, 0, 16])


def test_text_by_the_fonts_of_the_page(rich):
    runs = rows(text.text_runs(text.content_bytes(rich), formats.page_fonts(rich)), "obj_num", "text")
    assert (3, "c") not in runs and (3, "a") in runs
    (own,) = [f for f in formats.page_fonts(rich).where("obj_num = 3").collect()[0].fonts]
    assert own.widths == {32: 250.0, 33: 333.5, 34: 400.0} and own.texts == {1: "A"} and own.differences == {65: "a", 66: "b", 70: "c"}


def test_what_cannot_be_read_is_an_error_row(spark):
    def work(raw):
        if raw == b"bad":
            raise ValueError("no")
        return [{"v": len(raw)}]

    given = spark.createDataFrame([("f", "p", 1, bytearray(b"good")), ("f", "p", 2, bytearray(b"bad")), ("f", "p", 3, None)], "file_id string, path string, obj_num int, stream_decoded binary")
    got = {r.obj_num: ([x.v for x in r._r], r.error) for r in text._mapped(given, work, "array<struct<v:int>>").collect()}
    assert got == {1: ([4], None), 2: ([], "ValueError: no"), 3: ([], None)}
    assert text.content_errors(given).count() == 0


def test_strip_fills_the_file(spark):
    given = spark.createDataFrame([("f", 10, 20, 50, "a"), ("f", 25, 50, 50, "b"), ("g", 0, 50, 50, "c")], "f string, b long, e long, n long, name string")
    assert rows(layout.strip(given, ["f"], "b", "e", "n", "name"), "f", "begin", "end", "label") == {
        ("f", 0, 10, "gap"), ("f", 10, 20, "a"), ("f", 20, 25, "gap"), ("f", 25, 50, "b"), ("g", 0, 50, "c")}


def test_cid_widths(spark):
    d, n = W.dictionary, W.wrap
    font = d(Type="Font", Subtype="CIDFontType2", W=[3, [10, 20], 7, 9, 30.5, 20, [40]])
    far = d(Type="Font", Subtype="CIDFontType2", W=W.ref(3))
    data = W.assemble([(1, font), (2, far), (3, n([1, 2, 5]))], {"Root": W.ref(1)})
    got = rows(formats.cid_widths(Corpus.from_binary(files(spark, data))), "obj_num", "code", "width")
    assert got == {(1, 3, 10.0), (1, 4, 20.0), (1, 7, 30.5), (1, 8, 30.5), (1, 9, 30.5), (1, 20, 40.0), (2, 1, 5.0), (2, 2, 5.0)}


def test_detail_text(rich):
    got = {r.obj_num: r.detail for r in graph.detail_text(rich).collect()}
    assert got[23] == "[\n  /PDF\n  /Text\n]" and got[28] == "5"
    assert got[4] == "<<\n  /Type  /Page\n  /Parent  2 0 R\n  /Contents  [ 6 0 R  7 0 R ]\n  /Kids  [ 2 0 R ]\n>>"
    assert got[25].split("\n")[4] == "  /CIDSystemInfo  <<" and got[25].split("\n")[5] == "    /Registry  (Adobe)"
    n = len(W.stream(bytes([255, 0, 0, 0, 0, 16])).data[1])
    assert got[14].endswith(f">>\nstream\n[{n} bytes raw]\n[6 bytes decoded]")


def test_ancestors_of_names_with_full_stops(spark):
    d = W.dictionary
    value = d(**{"A.B": d(**{"C.": [d(X=1), 2]}), "A": d(B=3)})
    c = Corpus.from_binary(files(spark, W.assemble([(1, d(Type="Catalog")), (2, value)], {"Root": W.ref(1)})))
    c = Corpus(c.parsed.cache())
    nodes = c.nodes.where("obj_num = 2")
    up = {r.node_ix: r.parent_ix for r in nodes.collect()}

    def above(i):
        return {up[i]} | above(up[i]) if up[i] is not None else set()

    got = {}
    for r in graph.ancestors(nodes).collect():
        got.setdefault(r.node_ix, set()).add(r.above_ix)
    assert got == {i: above(i) for i in up if above(i)}
    assert graph.visible_rows(nodes, nodes.where("depth = 0")).count() == 3 and graph.ancestors(nodes.limit(0)).count() == 0


def test_annotated_dump(spark):
    raw = bytes(range(40))
    streams = spark.createDataFrame([("f", "p", 1, bytearray(raw))], "file_id string, path string, obj_num int, stream_decoded binary")
    sections = spark.createDataFrame([("f", "p", 1, "B", 20, 20), ("f", "p", 1, "A", 0, 20)], "file_id string, path string, obj_num int, label string, offset long, size long")
    got = text.annotated_dump(sections, streams).first().dump
    row = lambda a, b: " ".join(f"{x:02X}" for x in raw[a:b])
    assert got == f"=== A ===\n    0x0000 – 0x0013  (20 bytes)\n0000: {row(0, 16)}\n0010: {row(16, 20)}\n\n=== B ===\n    0x0014 – 0x0027  (20 bytes)\n0014: {row(20, 36)}\n0024: {row(36, 40)}\n"
    cut = text.annotated_dump(sections, streams, limit=10).first().dump
    assert cut == f"=== A ===\n    0x0000 – 0x0013  (20 bytes)\n0000: {row(0, 10)}\n     … 10 more bytes …\n\n=== B ===\n    0x0014 – 0x0027  (20 bytes)\n     … 20 bytes (64K global limit reached) …\n"


def test_every_operator_is_described():
    from quire.functions.content import CATEGORIES, CATEGORY, COLORS, DESCRIPTIONS, LABELS

    assert set(CATEGORY) == set(DESCRIPTIONS) and set(CATEGORIES) == set(LABELS) == set(COLORS) and COLORS["inline_img"] == "inline"


def test_errors_of_formats(rich):
    # The font file of the fixture holds a word, not a font.
    assert rows(formats.errors(rich), "obj_num", "table", "error") == {(16, "ttf", "ValueError: not an sfnt font")}


def test_grid_width_of_any_count(spark):
    """The same steps in the query's SQL and in the operator, beyond 64 as well."""
    import duckdb

    from quire.plans.queries import SQL

    want = {256: 16, 257: 32, 1024: 32, 1025: 64, 4096: 64, 4097: 128, 16384: 128, 16385: 256, 70000: 256}
    rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", layout.grid_width(F.col("n")).alias("w"))
    assert {r.n: r.w for r in rows.collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE TABLE embeddings AS SELECT c AS label FROM (VALUES {', '.join(f'({n})' for n in want)}) t(c), LATERAL (SELECT unnest(range(0, c)))")
    assert {n: w for _, n, w in con.execute(SQL["q52_glyph_grid"]).fetchall()} == want
