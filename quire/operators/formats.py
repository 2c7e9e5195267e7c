"""Fonts, character maps, colour profiles, images and hint tables of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.codes import IDENTITY, read_code_map
from quire.functions.formats import FONT_FLAGS, PREDICTORS, code_texts
from quire.session import discard, written

from . import pagetree
from .corpus import Corpus
from .graph import classify, lookup, palette_references
from .text import _mapped

KEY = ["file_id", "path", "obj_num"]
CMAP = "array<struct<seq:int,src_int:bigint,src_hex:string,dst_hex:string,code_point:int,char:string>>"
CODE_MAP = "array<struct<spaces:array<struct<n:int,low:bigint,high:bigint>>,cids:array<struct<n:int,low:bigint,high:bigint,cid:bigint>>,uses:string>>"
CODE_TEXTS = "array<struct<texts:map<bigint,string>,wide_texts:map<bigint,string>>>"
ICC_TAG = "array<struct<sig:string,name:string,type_sig:string,offset:bigint,size:bigint,summary:string>>"
SEGMENT = "array<struct<label:string,offset:bigint,size:bigint>>"
ICC_HEAD = (
    "array<struct<total_size:bigint,version:string,profile_class:string,color_space:string,pcs:string,description:string,copyright:string,white_point:array<double>,"
    "black_point:array<double>,r_xyz:array<double>,g_xyz:array<double>,b_xyz:array<double>,r_trc:array<double>,g_trc:array<double>,b_trc:array<double>>>"
)
JPEG = "array<struct<marker:string,name:string,offset:bigint,size:bigint,summary:string,is_scan:boolean>>"
FRAME = "array<struct<type:string,precision:int,height:int,width:int,components:int>>"
TTF = "array<struct<tag:string,checksum:string,offset:bigint,length:bigint,desc:string>>"
HINT_PAGES = "array<struct<page:int,nobjects:bigint,page_length:bigint,content_offset:bigint,content_length:bigint,nshared:bigint,shared_ids:array<bigint>>>"
HINT_GROUPS = "array<struct<group:int,group_length:bigint,nobjects:bigint,first_obj:bigint,section:string>>"


def _labelled(c: Corpus, label: str) -> DataFrame:
    return c.dealt(c.streams.join(classify(c).where(F.col("type_label") == label).select(*KEY), KEY, "left_semi"), *KEY)


def _table(rows: DataFrame, work, schema: str, column: str = "stream_decoded") -> DataFrame:
    return _mapped(rows, work, schema, column).select(*KEY, F.inline("_r"))


def errors(c: Corpus) -> DataFrame:
    """``KEY, table, error``: streams that a format table has no rows for, with the reason."""
    from quire.functions.formats import cmap, icc, jpeg, ttf_tables

    def failed(table: str, rows: DataFrame, work, column: str = "stream_decoded") -> DataFrame:
        # The reader's own result is not wanted, only whether it has one; streams that cannot be decoded are told too.
        def tried(raw):
            work(raw)
            return [{"x": 1}]

        unread = rows.where(F.col(column).isNull()).select(*KEY, F.lit("cannot be decoded").alias("error"))
        wrong = _mapped(rows, tried, "array<struct<x:int>>", column).where("error is not null").select(*KEY, "error")
        return unread.union(wrong).select(*KEY, F.lit(table).alias("table"), "error")

    pictures = c.streams.where(F.array_contains("filters", "DCTDecode"))
    out = failed("cmaps", _labelled(c, "ToUnicode CMap"), cmap).union(failed("icc", _labelled(c, "ICC Profile"), icc)).union(failed("ttf", _labelled(c, "Font File (TrueType)"), ttf_tables))
    return out.union(failed("jpeg", pictures, jpeg, "stream_raw")).union(image_pixels(c).where("error is not null").select(*KEY, F.lit("images"), "error"))


def cmaps(c: Corpus) -> DataFrame:
    """All mappings of ToUnicode maps in code order."""
    from quire.functions.formats import cmap

    return _table(_labelled(c, "ToUnicode CMap"), lambda b: cmap(b)["rows"], CMAP)


def parse_cmaps(rows: DataFrame) -> DataFrame:
    """Mappings of ``rows(file_id, path, obj_num, stream_decoded)``."""
    from quire.functions.formats import cmap

    return _table(rows, lambda b: cmap(b)["rows"], CMAP)


def rendering_map(maps: DataFrame) -> DataFrame:
    """The first mapping of each code."""
    w = Window.partitionBy(*KEY, "src_int").orderBy("seq")
    return maps.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def icc_headers(c: Corpus) -> DataFrame:
    from quire.functions.formats import icc

    return _table(_labelled(c, "ICC Profile"), lambda b: [icc(b)["header"]], ICC_HEAD)


def icc_tags(c: Corpus) -> DataFrame:
    from quire.functions.formats import icc

    return _table(_labelled(c, "ICC Profile"), lambda b: icc(b)["tags"], ICC_TAG)


def icc_segments(c: Corpus) -> DataFrame:
    from quire.functions.formats import icc

    return _table(_labelled(c, "ICC Profile"), lambda b: icc(b)["segments"], SEGMENT)


def srgb_preview(x: Column, y: Column, z: Column) -> Column:
    """RGB triple of a D50 colour: Bradford adaptation to D65, linear sRGB, gamma; halves round to even."""
    # Bradford D50 to D65, and XYZ to linear sRGB.
    adapt = ((0.9555766, -0.0230393, 0.0631636), (-0.0282895, 1.0099416, 0.0210077), (0.0122982, -0.0204830, 1.3299098))
    linear = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    for m in (adapt, linear):
        x, y, z = (F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) * z for r in m)

    def gamma(v: Column) -> Column:
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        return F.bround(F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, 1 / 2.4) * 1.055 - 0.055) * 255).cast("int")

    return F.array(gamma(x), gamma(y), gamma(z))


def jpeg_segments(c: Corpus) -> DataFrame:
    from quire.functions.formats import jpeg

    rows = c.streams.where(F.array_contains("filters", "DCTDecode"))
    return _table(rows, lambda b: jpeg(b)["segments"], JPEG, "stream_raw")


def jpeg_frames(c: Corpus) -> DataFrame:
    from quire.functions.formats import jpeg

    rows = c.streams.where(F.array_contains("filters", "DCTDecode"))
    return _table(rows, lambda b: [f] if (f := jpeg(b)["frame"]) else [], FRAME, "stream_raw")


def ttf_tables(c: Corpus) -> DataFrame:
    from quire.functions.formats import ttf_tables

    return _table(_labelled(c, "Font File (TrueType)"), ttf_tables, TTF)


def ttf_files(c: Corpus) -> DataFrame:
    """Font programs, completed with the tables that strict readers want."""
    from quire.functions.formats import ttf_complete

    return _table(_labelled(c, "Font File (TrueType)"), lambda b: [{"font": ttf_complete(b)}], "array<struct<font:binary>>")


def bitmap_numbers(raw: Column) -> Column:
    """Numbers of the set bits, the most significant first."""
    bits = F.sequence(F.lit(0), F.octet_length(raw) * 8 - 1)

    def set_(i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(raw, F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.expr("1") == F.pmod(F.floor(byte / F.pow(F.lit(2), 7 - F.pmod(i, F.lit(8)))), F.lit(2))

    return F.when(F.octet_length(raw) > 0, F.filter(bits, set_)).otherwise(F.array().cast("array<int>"))


def cid_sets(rows: DataFrame, raw: str = "stream_decoded") -> DataFrame:
    """``rows`` with the slots, count and last number of a CIDSet, and its bytes in hexadecimal."""
    have = bitmap_numbers(F.col(raw))
    return rows.withColumn("_n", have).select(
        *[x for x in rows.columns if x != raw], (F.octet_length(raw) * 8).alias("total_slots"), F.size("_n").alias("present_count"), F.array_max("_n").alias("last_cid"), F.hex(raw).alias("coverage_hex")
    )


def cid_map(rows: DataFrame, raw: str = "stream_decoded") -> DataFrame:
    """``rows`` exploded to ``cid, gid`` of a CIDToGIDMap; zeros are left out."""
    n = F.floor(F.octet_length(raw) / 2).cast("int")
    gid = lambda i: F.conv(F.hex(F.substring(F.col(raw), i * 2 + 1, F.lit(2))), 16, 10).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("cid"), gid(i).alias("gid")))
    return rows.where(n > 0).select(*[x for x in rows.columns if x != raw], F.inline(pairs)).where("gid > 0")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x)), 2, "0") for x in (r, g, b)])


def is_dark(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114 < 128


def palettes(c: Corpus) -> DataFrame:
    """Entries of palette streams as RGB; channels follow the base colour space."""
    base = c.nodes.where("key in ('[0]','[1]','[3]')").groupBy("file_id", "path", F.col("obj_num").alias("from_num"), "parent_ix").agg(
        F.max(F.when(F.col("key") == "[0]", F.col("str_v"))).alias("head"), F.max(F.when(F.col("key") == "[1]", F.col("str_v"))).alias("base"),
        F.max(F.when(F.col("key") == "[3]", F.col("ref_num"))).alias("obj_num"),
    ).where("head = 'Indexed' and obj_num is not null")
    rows = c.streams.join(base.select(*KEY, "base").dropDuplicates(KEY), KEY)
    n = F.when(F.col("base") == "DeviceGray", 1).when(F.col("base") == "DeviceCMYK", 4).otherwise(3)
    at = lambda i, k: F.conv(F.hex(F.substring(F.col("stream_decoded"), i * F.col("channels") + k + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumn("channels", n).withColumn("entries", F.floor(F.octet_length("stream_decoded") / F.col("channels")).cast("int")).where("entries > 0")

    def entry(i: Column) -> Column:
        ink = lambda k: F.rint((255 - at(i, k)) * (255 - at(i, 3)) / 255).cast("int")
        part = lambda k: F.when(F.col("channels") == 1, at(i, 0)).when(F.col("channels") == 4, ink(k)).otherwise(at(i, k))
        return F.struct(i.alias("index"), part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))

    rows = rows.select(*KEY, F.inline(F.transform(F.sequence(F.lit(0), F.col("entries") - 1), entry)))
    return rows.select("*", rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), is_dark(F.col("r"), F.col("g"), F.col("b")).alias("dark_bg"))


def _top(c: Corpus, keys: list[str]) -> DataFrame:
    """Top-level entries of every object, one column a key: the scalar as text, and its reference."""
    top = c.nodes.where((F.col("depth") == 1) & F.col("key").isin(keys))
    text = F.coalesce("str_v", F.col("int_v").cast("string"), F.col("real_v").cast("string"), F.col("bool_v").cast("string"))
    return top.groupBy(*KEY).agg(
        *[F.max(F.when(F.col("key") == k, text)).alias(k) for k in keys], *[F.max(F.when(F.col("key") == k, F.col("ref_num"))).alias(f"{k}_ref") for k in keys]
    )


def font_descriptors(c: Corpus) -> DataFrame:
    keys = ["FontName", "Flags", "Ascent", "Descent", "CapHeight", "XHeight", "ItalicAngle", "StemV", "StemH", "FontWeight", "MissingWidth", "FontFile", "FontFile2", "FontFile3", "CIDSet"]
    rows = c.objects.where("type_name = 'FontDescriptor'").select(*KEY).join(_top(c, keys), KEY, "left")
    box = c.nodes.where("key_path rlike '^FontBBox\\\\.'").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("real_v", F.col("int_v").cast("double")).alias("v")))).alias("b"))
    flags = F.col("Flags").cast("int")
    names = F.array_compact(F.array(*[F.when(F.shiftright(flags, bit - 1).bitwiseAND(1) == 1, F.lit(n)) for bit, n in FONT_FLAGS.items()]))
    number = lambda k: F.col(k).cast("double")
    return rows.join(box, KEY, "left").select(
        *KEY, F.col("FontName").alias("font_name"), flags.alias("flags_raw"), names.alias("flags"), number("Ascent").alias("ascent"), number("Descent").alias("descent"),
        number("CapHeight").alias("cap_height"), number("XHeight").alias("x_height"), number("ItalicAngle").alias("italic_angle"), number("StemV").alias("stem_v"), number("StemH").alias("stem_h"),
        number("FontWeight").alias("font_weight"), number("MissingWidth").alias("missing_width"), F.transform("b", lambda x: x["v"]).alias("bbox"),
        F.coalesce("FontFile2_ref", "FontFile_ref", "FontFile3_ref").alias("font_file_num"), F.col("CIDSet_ref").alias("cidset_num"),
    )


def fonts(c: Corpus) -> DataFrame:
    """Simple fonts: names, code range, widths (integers and reals alike), what embeds them."""
    keys = ["BaseFont", "Encoding", "FirstChar", "LastChar", "FontDescriptor", "ToUnicode", "Widths"]
    rows = c.objects.where("type_name = 'Font' and coalesce(subtype, '') not in ('Type0', 'CIDFontType0', 'CIDFontType2')").select(*KEY, "subtype").join(_top(c, keys), KEY, "left")
    value = F.coalesce("real_v", F.col("int_v").cast("double"))
    own = c.nodes.where("key_path rlike '^Widths\\\\.'").select(*KEY, "ord", value.alias("w"))
    apart = c.nodes.where("depth = 1 and key rlike '^\\\\['").select("file_id", "path", F.col("obj_num").alias("Widths_ref"), "ord", value.alias("w"))
    named = rows.where("Widths_ref is not null").select(*KEY, "Widths_ref").join(apart, ["file_id", "path", "Widths_ref"]).select(*KEY, "ord", "w")
    widths = own.union(named).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ord", "w"))).alias("ws"))
    files = font_descriptors(c).select("file_id", "path", F.col("obj_num").alias("FontDescriptor_ref"), F.col("font_file_num").isNotNull().alias("embedded"))
    return rows.join(widths, KEY, "left").join(files, ["file_id", "path", "FontDescriptor_ref"], "left").select(
        *KEY, F.col("BaseFont").alias("base_font"), "subtype", F.col("Encoding").alias("encoding"), F.col("FirstChar").cast("int").alias("first_char"), F.col("LastChar").cast("int").alias("last_char"),
        F.transform("ws", lambda x: x["w"]).alias("widths"), F.coalesce("embedded", F.lit(False)).alias("is_embedded"), F.col("FontDescriptor_ref").alias("font_descriptor_num"), F.col("ToUnicode_ref").alias("to_unicode_num"),
    )


def encoding_differences(c: Corpus) -> DataFrame:
    """``code, glyph`` of /Differences arrays: numbers set the code, the names after them count on."""
    items = c.nodes.where("key_path rlike '^(Encoding\\\\.)?Differences\\\\.\\\\['")
    w = Window.partitionBy(*KEY, "parent_ix").orderBy("ord")
    rows = items.withColumn("base", F.last("int_v", ignorenulls=True).over(w)).withColumn("at", F.last(F.when(F.col("int_v").isNotNull(), F.col("ord")), ignorenulls=True).over(w))
    return rows.where("kind = 'Name'").select(*KEY, (F.coalesce("base", F.lit(0)) + F.col("ord") - F.coalesce("at", F.lit(-1)) - 1).alias("code"), F.col("str_v").alias("glyph"))


def type0_fonts(c: Corpus) -> DataFrame:
    """Composite fonts with their descendant and its character collection; the default width is 1000."""
    rows = c.objects.where("type_name = 'Font' and subtype = 'Type0'").select(*KEY).join(_top(c, ["BaseFont", "Encoding", "ToUnicode"]), KEY, "left")
    child = c.nodes.where("key_path = 'DescendantFonts.[0]' and kind = 'Reference'").select(*KEY, F.col("ref_num").alias("descendant_num"))
    system = c.nodes.where("key_path rlike '^CIDSystemInfo\\\\.'").groupBy("file_id", "path", F.col("obj_num").alias("descendant_num")).agg(
        F.max(F.when(F.col("key") == "Registry", F.col("str_v"))).alias("cid_registry"), F.max(F.when(F.col("key") == "Ordering", F.col("str_v"))).alias("cid_ordering"),
        F.max(F.when(F.col("key") == "Supplement", F.col("int_v"))).alias("cid_supplement"))
    kid = _top(c, ["BaseFont", "Subtype", "DW", "FontDescriptor"]).select(
        "file_id", "path", F.col("obj_num").alias("descendant_num"), F.col("BaseFont").alias("cid_base_font"), F.col("Subtype").alias("cid_subtype"),
        F.coalesce(F.col("DW").cast("double"), F.lit(1000.0)).alias("default_width"), F.col("FontDescriptor_ref").alias("font_descriptor_num"))
    at = ["file_id", "path", "descendant_num"]
    return rows.join(child, KEY, "left").join(kid, at, "left").join(system, at, "left").select(
        *KEY, F.col("BaseFont").alias("base_font"), F.col("Encoding").alias("encoding"), F.col("Encoding_ref").alias("encoding_num"), F.col("ToUnicode_ref").alias("to_unicode_num"), "descendant_num", "cid_subtype", "cid_base_font", "cid_registry",
        "cid_ordering", "cid_supplement", F.coalesce("default_width", F.lit(1000.0)).alias("default_width"), "font_descriptor_num")


def images(c: Corpus) -> DataFrame:
    """Images: size, samples, filter, bytes before and after decoding, and the parameters of their codec."""
    keys = ["Width", "Height", "BitsPerComponent", "ColorSpace", "ImageMask"]
    rows = c.objects.where("subtype = 'Image'").select(*KEY, "filters").join(_top(c, keys), KEY, "left")
    part = c.nodes.where("key_path rlike '^DecodeParms\\\\.(\\\\[[0-9]+\\\\]\\\\.)?[A-Za-z0-9]+$'").groupBy(*KEY).agg(
        *[F.max(F.when(F.col("key") == k, F.coalesce("int_v", F.col("bool_v").cast("long")))).alias(k) for k in ("K", "Columns", "Rows", "BlackIs1", "EncodedByteAlign", "Predictor", "Colors")])
    size = c.streams.select(*KEY, F.octet_length("stream_raw").alias("raw_size"), F.octet_length("stream_decoded").alias("decoded_size"))
    predictor = F.coalesce(F.col("Predictor"), F.lit(1))
    names = F.create_map(*[F.lit(x) for kv in PREDICTORS.items() for x in kv])
    k = F.coalesce(F.col("K"), F.lit(0))
    fax = F.when(F.array_contains("filters", "CCITTFaxDecode"), F.when(k < 0, "G4").when(k == 0, "G3-1D").otherwise("G3-2D"))
    rows = rows.join(part, KEY, "left").join(size, KEY, "left").join(jpeg_frames(c).withColumnRenamed("width", "jpeg_width").withColumnRenamed("height", "jpeg_height"), KEY, "left")
    return rows.select(
        *KEY, F.coalesce(F.col("Width").cast("int"), F.col("jpeg_width")).alias("width"), F.coalesce(F.col("Height").cast("int"), F.col("jpeg_height")).alias("height"),
        F.col("BitsPerComponent").cast("int").alias("bits_per_component"), F.col("ColorSpace").alias("color_space"), F.try_element_at("filters", F.lit(-1)).alias("filter"),
        F.coalesce(F.col("ImageMask") == "true", F.lit(False)).alias("is_image_mask"), "raw_size", "decoded_size", fax.alias("compression_short"),
        predictor.alias("predictor"), F.coalesce(names[predictor.cast("int")], F.lit("Unknown")).alias("predictor_name"), F.col("Columns").alias("columns"), F.coalesce("Colors", F.lit(1)).alias("colors"),
        F.struct(k.alias("k"), F.col("Columns").alias("columns"), F.col("Rows").alias("rows"), F.col("BlackIs1").alias("black_is_1"), F.col("EncodedByteAlign").alias("byte_align")).alias("fax"),
    )


def cid_widths(c: Corpus) -> DataFrame:
    """``code, width`` of /W arrays: a first code and an array of widths, or a first code, a last one and their width."""
    cols = ["node_ix", "parent_ix", "ord", "kind", F.coalesce("real_v", F.col("int_v").cast("double")).alias("v")]
    own = c.nodes.where("key_path rlike '^W\\\\.\\\\['").select(*KEY, (F.col("depth") - 2).alias("level"), *cols)
    named = c.entry("W").where("kind = 'Reference'").select("file_id", "path", F.col("obj_num").alias("font"), F.col("ref_num").alias("obj_num"))
    far = c.nodes.where("key_path rlike '^\\\\['").join(named, KEY).select("file_id", "path", F.col("font").alias("obj_num"), (F.col("depth") - 1).alias("level"), *cols)
    rows = own.union(far)
    w = Window.partitionBy(*KEY).orderBy("ord")
    lead = lambda n, k=1: F.lead(n, k).over(w)
    # Numbers count on from the last array; every third begins a range, unless an array follows it.
    last_array = F.last(F.when(F.col("kind") == "Array", F.col("ord")), ignorenulls=True).over(w)
    items = rows.where("level = 0").select(*KEY, "kind", "v", (F.col("ord") - F.coalesce(last_array, F.lit(-1)) - 1).alias("p"), lead("kind").alias("next"), lead("v").alias("v1"), lead("v", 2).alias("v2"), lead("node_ix").alias("parent_ix"))
    starts = items.where("kind <> 'Array' and p % 3 = 0")
    ranges = starts.where("next <> 'Array' and v2 is not null and v1 >= v").select(*KEY, F.explode(F.sequence(F.col("v").cast("int"), F.col("v1").cast("int"))).alias("code"), F.col("v2").alias("width"))
    lists = starts.where("next = 'Array'").select(*KEY, "parent_ix", F.col("v").alias("first"))
    each = rows.where("level = 1 and v is not null").select(*KEY, "parent_ix", "ord", F.col("v").alias("width"))
    return ranges.union(lists.join(each, [*KEY, "parent_ix"]).select(*KEY, (F.col("first") + F.col("ord")).cast("int"), "width"))


def code_maps(c: Corpus) -> DataFrame:
    """Maps of composite fonts, with those that they use: ``KEY`` of the map, ``code_map``, ``unknown_map``.

    A map uses another by its ``UseCMap`` entry or by ``usecmap``; its own ranges
    come first.  A chain of any length is followed, a map that is met again ends
    it.  ``unknown_map`` is a predefined map in the chain whose codes are not in
    the file; identity is no such map.
    """
    at = ["file_id", "path"]
    named = type0_fonts(c).where("encoding_num is not null").select(*at, F.col("encoding_num").alias("obj_num"))
    link = c.entry("UseCMap").select(*KEY, F.col("ref_num").alias("next"), F.when(F.col("kind") == "Name", F.col("str_v")).alias("next_name"))
    start = named.union(link.where("next is not null").select(*at, F.col("next"))).distinct()
    parsed = _mapped(c.streams.join(start, KEY, "left_semi"), lambda b: [read_code_map(b)], CODE_MAP).select(*KEY, F.inline("_r")).join(link, KEY, "left")
    parsed = written(parsed.select(*KEY, "spaces", "cids", "next", F.coalesce("next_name", F.when(F.col("next").isNull(), F.col("uses"))).alias("next_name")), "code-maps")
    level, depth, out = parsed.select(*KEY, F.array("obj_num").alias("trail"), "spaces", "cids", "next", "next_name"), 0, None
    while True:
        part = level.select(*KEY, F.lit(depth).alias("depth"), "spaces", "cids", "next_name")
        out = part if out is None else out.union(part)
        used = parsed.select(*at, F.col("obj_num").alias("next"), F.col("spaces").alias("s"), F.col("cids").alias("i"), F.col("next").alias("after"), F.col("next_name").alias("after_name"))
        step = level.where("next is not null").join(used, [*at, "next"]).where(~F.array_contains("trail", F.col("next")))
        level = written(step.select(*KEY, F.array_append("trail", F.col("next")).alias("trail"), F.col("s").alias("spaces"), F.col("i").alias("cids"), F.col("after").alias("next"), F.col("after_name").alias("next_name")), "code-maps")
        if level.isEmpty():
            discard(level)
            break
        depth += 1
    chain = out.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("depth", "spaces", "cids"))).alias("ms"), F.max("next_name").alias("last"))
    flat = lambda name: F.flatten(F.transform("ms", lambda m: m[name]))
    same = F.col("last").isin(*IDENTITY)
    two = F.array(F.struct(F.lit(2).alias("n"), F.lit(0).cast("bigint").alias("low"), F.lit(0xFFFF).cast("bigint").alias("high")))
    all_cids = F.array(F.struct(F.lit(2).alias("n"), F.lit(0).cast("bigint").alias("low"), F.lit(0xFFFF).cast("bigint").alias("high"), F.lit(0).cast("bigint").alias("cid")))
    spaces, cids = F.when(same, F.concat(flat("spaces"), two)).otherwise(flat("spaces")), F.when(same, F.concat(flat("cids"), all_cids)).otherwise(flat("cids"))
    return chain.select(*KEY, F.struct(spaces.alias("spaces"), cids.alias("cids")).alias("code_map"), F.when(~same, F.col("last")).alias("unknown_map"))


def page_fonts(c: Corpus) -> DataFrame:
    """Pages with ``fonts``: what each font name of the page stands for, as ``text.text_runs`` reads it.

    Simple fonts have codes of a byte and a default width of 500; composite ones the codes of their map (two bytes
    where it is identity) and the width of their descendant.  Predefined maps other than identity are in ``unknown_map``.
    """
    def as_map(rows: DataFrame, code: str, value: str, name: str) -> DataFrame:
        return rows.where(F.col(value).isNotNull()).dropDuplicates([*KEY, code]).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.col(code).cast("int"), value))).alias(name))

    first = F.coalesce("first_char", F.lit(0))
    own = F.when(F.size("widths") > 0, F.map_from_arrays(F.sequence(first, first + F.size("widths") - 1), "widths"))
    simple = fonts(c).select(*KEY, "encoding", F.lit(None).cast("int").alias("encoding_num"), "to_unicode_num", F.lit(1).alias("code_bytes"), F.lit(500.0).alias("default_width"), own.alias("widths"))
    composite = type0_fonts(c).select(*KEY, "encoding", "encoding_num", "to_unicode_num", F.lit(2).alias("code_bytes"), "default_width", "descendant_num")
    wide = as_map(cid_widths(c), "code", "width", "widths").withColumnRenamed("obj_num", "descendant_num")
    composite = composite.join(wide, ["file_id", "path", "descendant_num"], "left").select(*simple.columns)
    every = simple.union(composite)
    maps = c.dealt(c.streams.join(every.select("file_id", "path", F.col("to_unicode_num").alias("obj_num")), KEY, "left_semi"), *KEY)
    # A code is looked up with its width first, then as a number alone.
    texts = _table(maps, lambda b: [code_texts(b)], CODE_TEXTS).withColumnRenamed("obj_num", "to_unicode_num")
    own_maps = code_maps(c).withColumnRenamed("obj_num", "encoding_num")
    # Differences stand in the font or in an encoding object that it names.
    codes = as_map(encoding_differences(c), "code", "glyph", "differences")
    apart = c.entry("Encoding").where("kind = 'Reference'").select(*KEY, F.col("ref_num").alias("encoding_num")).join(codes.withColumnRenamed("obj_num", "encoding_num"), ["file_id", "path", "encoding_num"]).select(*KEY, "differences")
    every = every.join(texts, ["file_id", "path", "to_unicode_num"], "left").join(codes.unionByName(apart).dropDuplicates(KEY), KEY, "left")
    every = every.join(own_maps, ["file_id", "path", "encoding_num"], "left")
    predefined = F.when((F.col("code_bytes") > 1) & F.col("encoding_num").isNull() & ~F.col("encoding").isin(*IDENTITY), F.col("encoding"))
    every = every.withColumn("unknown_map", F.coalesce("unknown_map", predefined))
    on = page_resources(c, "Font").select("file_id", "path", F.col("obj_num").alias("page"), "name", F.col("ref_num").alias("obj_num"))
    rows = on.join(every, KEY).select("file_id", "path", F.col("page").alias("obj_num"), F.struct("name", "encoding", "code_bytes", "default_width", "widths", "texts", "wide_texts", "differences", "code_map", "unknown_map").alias("f"))
    return rows.groupBy(*KEY).agg(F.collect_list("f").alias("fonts"))


def color_spaces(c: Corpus) -> DataFrame:
    """Colour space of each image: ``channels``; of indexed ones ``base_channels`` and the ``lookup`` bytes."""
    cols = ["ord", "kind", "str_v", "ref_num"]
    own = c.nodes.where("key_path rlike '^ColorSpace\\\\.\\\\[[0-9]+\\\\]$'").select(*KEY, *cols)
    entry = c.entry("ColorSpace")
    named = entry.where("kind = 'Reference'").select("file_id", "path", F.col("obj_num").alias("image"), F.col("ref_num").alias("obj_num"))
    far = c.nodes.where("depth = 1 and key rlike '^\\\\['").join(named, KEY).select("file_id", "path", F.col("image").alias("obj_num"), *cols)
    item = lambda i, v: F.max(F.when(F.col("ord") == i, F.col(v)))
    arrays = own.union(far).groupBy(*KEY).agg(item(0, "str_v").alias("head"), item(1, "str_v").alias("base"), item(1, "ref_num").alias("profile"), item(3, "str_v").alias("inline"), item(3, "ref_num").alias("lookup_num"))
    names = entry.where("kind = 'Name'").select(*KEY, F.col("str_v").alias("name"))
    n_of = c.entry("N").where("kind = 'Integer'").select("file_id", "path", F.col("obj_num").alias("profile"), F.col("int_v").cast("int").alias("n"))
    bytes_ = c.streams.select("file_id", "path", F.col("obj_num").alias("lookup_num"), F.col("stream_decoded").alias("bytes"))
    rows = c.objects.where("subtype = 'Image'").select(*KEY).join(arrays, KEY, "left").join(names, KEY, "left")
    rows = rows.join(n_of, ["file_id", "path", "profile"], "left").join(bytes_, ["file_id", "path", "lookup_num"], "left")

    def channels(name: Column) -> Column:
        return F.when(name.isin("DeviceGray", "CalGray", "G"), 1).when(name.isin("DeviceCMYK", "CMYK"), 4).when(name.isin("DeviceRGB", "CalRGB", "Lab", "RGB"), 3)

    indexed = F.coalesce(F.col("head").isin("Indexed", "I"), F.lit(False))
    direct = F.coalesce(channels(F.col("name")), F.when(F.col("head") == "ICCBased", F.col("n")), channels(F.col("head")), F.lit(1))
    return rows.select(
        *KEY, F.when(indexed, 1).otherwise(direct).alias("channels"), F.when(indexed, F.coalesce(channels(F.col("base")), F.lit(3))).otherwise(1).alias("base_channels"),
        F.when(indexed, F.coalesce("bytes", F.encode("inline", "ISO-8859-1"))).alias("lookup"),
    )


def _image_inputs(c: Corpus) -> DataFrame:
    """Images with all that decoding them takes, a row each."""
    bits = F.when(F.col("is_image_mask"), 1).otherwise(F.col("bits_per_component")).alias("bits")
    rows = images(c).select(*KEY, "width", "height", bits, "fax", "is_image_mask").join(color_spaces(c), KEY)
    return c.dealt(rows.join(c.streams.select(*KEY, F.coalesce("filters", F.array().cast("array<string>")).alias("filters"), "stream_raw", "stream_decoded"), KEY), *KEY)


_IMAGE = ("filters", "stream_raw", "stream_decoded", "width", "height", "bits", "channels", "base_channels", "lookup", "fax")


def image_files(c: Corpus) -> DataFrame:
    """``format, data`` of each image: JPEG data as they are, samples as PNG; JPX and JBIG2 are ``unsupported``, without data."""
    from quire.functions.codecs import image_file

    def work(filters, raw, decoded, width, height, bits, channels, base_channels, lookup, fax, mask):
        kind, data = image_file(decoded, raw, filters, width or 0, height or 0, bits or 8, channels, lookup, base_channels, 1, 0, fax, bool(mask))
        return [{"format": kind, "data": data}]

    return _mapped(_image_inputs(c), work, "array<struct<format:string,data:binary>>", *_IMAGE, "is_image_mask").select(*KEY, F.inline_outer("_r"), "error")


def image_pixels(c: Corpus, chosen: Column | None = None) -> DataFrame:
    """``width, height, channels, pixels`` of each image, JPEG and CCITT ones too: grey or RGB of 8 bits (or 16, as they are); else ``error``.

    Only images for which ``chosen`` holds (of ``KEY, filters, width, height``) are decoded, all by default.
    """
    from quire.functions.codecs import image_samples

    def work(filters, raw, decoded, width, height, bits, channels, base_channels, lookup, fax):
        data, width, height, n, _ = image_samples(decoded, raw, filters, width or 0, height or 0, bits or 8, channels, lookup, base_channels, 1, 0, fax)
        return [{"width": width, "height": height, "channels": n, "pixels": data}]

    rows = _image_inputs(c) if chosen is None else _image_inputs(c).where(chosen)
    return _mapped(rows, work, "array<struct<width:int,height:int,channels:int,pixels:binary>>", *_IMAGE).select(*KEY, F.inline_outer("_r"), "error")


def coverage_bitmap(codes: DataFrame, code: str = "cid") -> DataFrame:
    """``coverage``: a bitmap in hexadecimal of the numbers of each object, the most significant bit first."""
    place = F.floor(F.col(code) / 8).cast("int")
    bytes_ = codes.groupBy(*KEY, place.alias("at")).agg(F.bit_or(F.call_function("shiftright", F.lit(128), F.pmod(F.col(code), F.lit(8)).cast("int"))).alias("byte"))
    rows = bytes_.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("m"), F.max("at").alias("top"))
    whole = F.transform(F.sequence(F.lit(0), "top"), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0))), 2, "0"))
    return rows.select(*KEY, F.array_join(whole, "").alias("coverage"))


def hint_group_labels(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Shared hint groups with the label of their first object, where the file has it."""
    lead = labels.select("file_id", "path", F.col("obj_num").alias("first_obj"), F.col("type_label").alias("lead_label"))
    return groups.join(lead, ["file_id", "path", "first_obj"], "left")


def groups_of_page(groups: DataFrame, pages: DataFrame, page: int) -> DataFrame:
    """The shared groups that a page's hint row names."""
    ids = pages.where(F.col("page") == page).select("file_id", "path", F.explode("shared_ids").alias("group"))
    return groups.join(ids.withColumn("group", F.col("group").cast("int")).distinct(), ["file_id", "path", "group"], "left_semi")


def linearization(c: Corpus) -> DataFrame:
    """Parameters of linearization dictionaries."""
    keys = ["Linearized", "L", "O", "N", "E", "T"]
    h = c.nodes.where("key_path in ('H.[0]', 'H.[1]')").groupBy(*KEY).agg(
        F.max(F.when(F.col("ord") == 0, F.col("int_v"))).alias("hint_offset"), F.max(F.when(F.col("ord") == 1, F.col("int_v"))).alias("hint_length"))
    rows = _top(c, keys).where("Linearized is not null").join(h, KEY, "left")
    whole = lambda k: F.col(k).cast("bigint")
    return rows.select(*KEY, whole("L").alias("file_length"), whole("O").alias("first_page_obj"), whole("N").alias("num_pages"), whole("E").alias("end_of_first_page"), whole("T").alias("main_xref_offset"), "hint_offset", "hint_length")


def hint_rows(rows: DataFrame, part: str = "pages") -> DataFrame:
    """Hint tables of ``rows(file_id, path, obj_num, data, num_pages, shared_at, first_page_obj)``: ``pages`` or ``shared_groups``."""
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    from quire.sources.pdf import arrow_type, slices

    schema = HINT_PAGES if part == "pages" else HINT_GROUPS
    kind = arrow_type(_parse_datatype_string(schema))

    def run(batches):
        from quire.functions.formats import hint_tables

        for b in slices(batches):
            out = []
            for data, n, at, first in zip(*(b.column(i).to_pylist() for i in range(3, 7))):
                try:
                    out.append(hint_tables(data, n, at, first or 0)[part])
                except Exception:
                    out.append([])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, kind)], names=[*KEY, "_r"])

    rows = rows.select(*KEY, "data", "num_pages", "shared_at", "first_page_obj")
    return rows.mapInArrow(run, f"file_id string, path string, obj_num int, _r {schema}").select(*KEY, F.inline("_r"))


def hint_streams(c: Corpus) -> DataFrame:
    """Hint streams with what their tables need to be read."""
    at = c.nodes.where("depth = 1 and key = 'S' and kind = 'Integer'").select(*KEY, F.col("int_v").alias("shared_at"))
    p = linearization(c).select("file_id", "path", "num_pages", "first_page_obj")
    return _labelled(c, "Linearization Hint Stream").join(at, KEY).join(p, ["file_id", "path"]).withColumn("data", F.col("stream_decoded"))


def page_resources(c: Corpus, kind: str) -> DataFrame:
    """Named resources of a kind for each page: its own, or those it inherits along the page tree."""
    return pagetree.resources(c, kind)


def page_boxes(c: Corpus) -> DataFrame:
    """Boxes of pages in points, own or inherited, and their size at 96 dots an inch; the crop box counts before the media box."""
    rows = pagetree.page_attributes(c).where("box is not null")
    return rows.select("*", pagetree.pixels(F.col("x1") - F.col("x0")).alias("px_width"), pagetree.pixels(F.col("y1") - F.col("y0")).alias("px_height"))
