"""The object graph: reference resolution, back-references, classification, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

from .corpus import Corpus

# Type names, image filters, subtype-qualified types, colour spaces, procedure sets, scalar names.
TYPES = {
    "Page": "Page", "Pages": "Pages Tree", "Catalog": "Catalog", "Font": "Font", "FontDescriptor": "Font Descriptor", "XObject": "XObject",
    "ObjStm": "Object Stream", "XRef": "Cross-Reference Stream", "Annot": "Annotation", "Action": "Action", "Encoding": "Encoding", "Pattern": "Pattern",
    "Shading": "Shading", "ExtGState": "Graphics State", "Metadata": "Metadata Stream", "OCG": "Optional Content Group", "OCMD": "Optional Content Membership",
    "Outlines": "Outlines", "Filespec": "File Specification", "EmbeddedFile": "Embedded File",
}
IMAGE_FILTERS = {"DCTDecode": "JPEG", "JPXDecode": "JPEG 2000", "FlateDecode": "Flate", "CCITTFaxDecode": "CCITT", "JBIG2Decode": "JBIG2"}
QUALIFIED = ["Font", "XObject", "Action", "Annot", "Pattern", "Shading"]
COLOR_SPACES = ["Indexed", "ICCBased", "CalRGB", "CalGray", "Lab", "Separation", "DeviceN", "Pattern"]
PROCEDURES = ["PDF", "Text", "ImageB", "ImageC", "ImageI"]
SCALARS = {"Integer": "Integer", "Real": "Real", "Name": "Name", "LiteralString": "String", "HexString": "String", "Boolean": "Boolean", "Reference": "Reference", "Null": "Null"}
RESOURCE_MAPS = {
    "Font": "Font Resource Map", "XObject": "XObject Resource Map", "ColorSpace": "Color Space Map", "Pattern": "Pattern Resource Map",
    "Shading": "Shading Resource Map", "Properties": "Properties Map",
}

KEY = ["file_id", "path", "obj_num"]


def lookup(column: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column]


def resolve(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """References with the kind of what they lead to; null where nothing is there.  Generations play no part."""
    target = objects.select("file_id", "path", F.col("obj_num").alias("ref_num"), F.col("kind").alias("target_kind"), F.col("type_name").alias("target_type"))
    return nodes.where("kind = 'Reference'").join(target, ["file_id", "path", "ref_num"], "left")


def reference_counts(c: Corpus) -> DataFrame:
    """How often each object is referenced, and from where first."""
    return c.backrefs.groupBy(*KEY).agg(F.count("*").alias("n_refs"), F.min("from_num").alias("min_from"), F.min_by("key_path", "ord").alias("first_path"))


def _facts(c: Corpus) -> DataFrame:
    """Per object what the rules look at: array heads, image filter, linearization."""
    top = c.nodes.where("obj_num >= 0 and depth = 1")
    return top.groupBy(*KEY).agg(
        F.max(F.when(F.col("key") == "[0]", F.when(F.col("kind") == "Name", F.col("str_v")))).alias("head"),
        F.count("*").alias("n_items"),
        F.bool_and((F.col("kind") == "Name") & F.coalesce(F.col("str_v").isin(PROCEDURES), F.lit(False))).alias("procedures"),
        F.max(F.when((F.col("key") == "Filter") & (F.col("kind") == "Name"), F.col("str_v"))).alias("filter"),
        F.coalesce(F.bool_or((F.col("key") == "Linearized") & (F.col("kind") == "Integer")), F.lit(False)).alias("is_linearization"),
    )


def hint_offsets(c: Corpus) -> DataFrame:
    """Offsets that the /H arrays of linearization dictionaries name."""
    at = c.nodes.where("kind = 'Integer' and key_path rlike '^H\\\\.\\\\[[0-9]*[02468]\\\\]$'").select("file_id", "path", "obj_num", F.col("int_v").alias("offset"))
    return at.join(_facts(c).where("is_linearization").select(*KEY), KEY, "left_semi").select("file_id", "path", "offset").distinct()


def classify(c: Corpus) -> DataFrame:
    """``file_id, path, obj_num, gen, type_label`` of every object.

    Each back-reference yields the label of the first rule that it fits; the
    back-reference with the smallest ``ord`` that has one decides.  Else the
    object's own structure does.
    """
    facts = _facts(c)
    own = c.objects.join(facts, KEY, "left")
    # Facts on the objects that references come from: how they are referenced themselves.
    parents = c.backrefs.groupBy(*KEY).agg(
        F.bool_or(F.col("key_path") == "Contents").alias("p_contents"), F.bool_or(F.col("key_path") == "PageLabels").alias("p_labels"),
        F.bool_or(F.col("key_path") == "Resources").alias("p_resources"), F.min_by("key_path", "ord").alias("p_path"), F.min_by("type_name", "ord").alias("p_type"),
    ).withColumnRenamed("obj_num", "from_num")
    shape = own.select("file_id", "path", F.col("obj_num").alias("from_num"), F.col("kind").alias("p_kind"), F.col("head").alias("p_head"), F.col("n_items").alias("p_items"))
    at = ["file_id", "path", "from_num"]
    refs = c.backrefs.join(own.select(*KEY, "kind"), KEY).join(parents, at, "left").join(shape, at, "left")
    k, t, kind = F.col("key_path"), F.col("type_name"), F.col("kind")
    label = (
        F.when(k == "Contents", F.when(kind == "Array", "Content Stream (Array)").otherwise("Content Stream"))
        .when(k.startswith("[") & (kind == "Stream") & F.col("p_contents"), "Content Stream")
        .when((k == "FontFile2") & (t == "FontDescriptor"), "Font File (TrueType)")
        .when((k == "ToUnicode") & (t == "Font"), "ToUnicode CMap")
        .when((k == "CIDToGIDMap") & (t == "Font"), "CID-to-GID Map")
        .when((k == "CIDSet") & (t == "FontDescriptor"), "CID Set")
        .when((k == "Info") & (t == "Trailer"), "Document Info")
        .when((k == "PageLabels") & (t == "Catalog"), "Page Labels Number Tree")
        .when(k.startswith("Nums.") & kind.isin("Dictionary", "Stream") & F.col("p_labels"), "Page Label")
        .when((k == "Length") & (F.col("p_kind") == "Stream"), "Stream Length")
        .when(k == "DecodeParms", "Decode Parameters")
        .when(k == "Resources", "Resource Dictionary")
        .when((t == "Dictionary") & F.col("p_resources") & k.isin(*RESOURCE_MAPS), lookup(k, RESOURCE_MAPS))
        .when(k.contains("ExtGState"), "Graphics State")
        .when(k == "Thumb", "Page Thumbnail")
        .when((k == "[1]") & (F.col("p_kind") == "Array") & (F.col("p_items") >= 2) & (F.col("p_head") == "ICCBased"), "ICC Profile")
        .when((k == "[3]") & (F.col("p_kind") == "Array") & (F.col("p_items") >= 4) & (F.col("p_head") == "Indexed"), "Color Palette")
    )
    first = F.struct("type_name", "p_path", "p_type")
    semantic = refs.withColumn("_label", label).groupBy(*KEY).agg(
        F.min_by("_label", F.when(F.col("_label").isNotNull(), F.col("ord"))).alias("semantic"), F.min_by(first, "ord").alias("r0")
    )
    hints = c.xref.where("etype = 'in_use'").join(hint_offsets(c), ["file_id", "path", "offset"], "left_semi").select(*KEY, F.lit(True).alias("hinted"))
    rows = own.join(semantic, KEY, "left").join(hints, KEY, "left")
    kind, typ, sub = F.col("kind"), F.col("type_name"), F.col("subtype")
    base = F.coalesce(lookup(typ, TYPES), typ)
    nick = lookup(F.col("filter"), IMAGE_FILTERS)
    of = F.when(F.col("r0.type_name") == "Array", F.when(F.col("r0.p_path") == "Contents", F.lit("Content Stream")).otherwise(F.concat(F.lit("Stream of "), F.col("r0.p_type")))).otherwise(
        F.concat(F.lit("Stream of "), F.col("r0.type_name"))
    )
    stream = F.when(F.col("r0").isNotNull(), F.coalesce(of, F.lit("Stream"))).when(F.col("hinted"), "Linearization Hint Stream").otherwise("Stream")
    entries = (
        F.when((kind == "Dictionary") & F.col("is_linearization"), "Linearization Dictionary")
        .when(sub == "Image", F.when(nick.isNotNull(), F.concat(F.lit("Image ("), nick, F.lit(")"))).otherwise("Image"))
        .when(typ.isNotNull(), F.when(sub.isNotNull() & typ.isin(QUALIFIED), F.concat(base, F.lit(" ("), sub, F.lit(")"))).otherwise(base))
        .when(kind == "Stream", stream).otherwise("Dictionary")
    )
    array = (
        F.when(F.col("head").isin(COLOR_SPACES), F.concat(F.lit("Color Space ("), F.col("head"), F.lit(")")))
        .when(F.col("procedures"), "Procedure Set").otherwise("Array")
    )
    structural = F.when(kind.isin("Dictionary", "Stream"), entries).when(kind == "Array", array).otherwise(F.coalesce(lookup(kind, SCALARS), F.lit("Unknown")))
    return rows.select(*KEY, "gen", F.when(kind.isNull(), F.when(F.col("error") == "unresolved", "—").otherwise("?")).otherwise(F.coalesce("semantic", structural)).alias("type_label"))


def owning_pages(c: Corpus) -> DataFrame:
    """The page of each content stream: directly, or through an array that /Contents names or holds."""
    refs = c.backrefs
    direct = refs.where("type_name = 'Page' and (key_path = 'Contents' or key_path rlike '^Contents\\\\.\\\\[')").select(*KEY, F.col("from_num").alias("page_num"))
    hop = refs.where("type_name = 'Array' and key_path rlike '^\\\\['").select(*KEY, F.col("from_num").alias("array_num"))
    named = direct.select("file_id", "path", F.col("obj_num").alias("array_num"), "page_num")
    return direct.union(hop.join(named, ["file_id", "path", "array_num"]).select(*KEY, "page_num")).distinct()


def page_order(c: Corpus) -> DataFrame:
    """Pages in document order: ``page_ix`` from 0.

    Levels are joined one by one, each a written table, until one is empty; a node met on its own path ends it.
    """
    kids = c.nodes.where("kind = 'Reference' and key_path rlike '^Kids\\\\.\\\\['").select("file_id", "path", "obj_num", F.col("ord").alias("kid_ix"), F.col("ref_num").alias("kid"))
    root = c.trailer().where("key = 'Root'").select("file_id", "path", F.col("ref_num").alias("obj_num"))
    top = c.entry("Pages").where("kind = 'Reference'").join(root, KEY, "left_semi").select("file_id", "path", F.col("ref_num").alias("num"))
    level = written(top.withColumn("trail", F.array("num")).withColumn("place", F.array().cast("array<int>")), "pages-level")
    pages = c.objects.where("type_name = 'Page'").select("file_id", "path", F.col("obj_num").alias("num"))
    out = level.select("file_id", "path", "num", "place").limit(0)
    while not level.isEmpty():
        found = level.join(pages, ["file_id", "path", "num"], "left_semi").select("file_id", "path", "num", "place")
        out = out.union(found)
        step = level.join(kids, (level.file_id == kids.file_id) & (level.path == kids.path) & (level.num == kids.obj_num)).where(~F.array_contains("trail", F.col("kid")))
        level = written(step.select(level.file_id, level.path, F.col("kid").alias("num"), F.array_append("trail", F.col("kid")).alias("trail"), F.array_append("place", F.col("kid_ix")).alias("place")), "pages-level")
    order = Window.partitionBy("file_id", "path").orderBy("place")
    return out.select("file_id", "path", F.col("num").alias("obj_num"), (F.row_number().over(order) - 1).alias("page_ix"))


def brief(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``brief``: a value in a few words."""
    s = F.col("str_v")
    text = (
        F.when(F.col("kind") == "Null", "null").when(F.col("kind") == "Boolean", F.col("bool_v").cast("string"))
        .when(F.col("kind") == "Integer", F.col("int_v").cast("string")).when(F.col("kind") == "Real", F.col("real_v").cast("string"))
        .when(F.col("kind") == "LiteralString", F.concat(F.lit("("), F.regexp_replace(F.regexp_replace(F.substring(s, 1, 80), "\r", r"\\\\r"), "\n", r"\\\\n"), F.lit(")")))
        .when(F.col("kind") == "HexString", F.concat(F.lit("<"), F.substring(F.hex(F.encode(s, "ISO-8859-1")), 1, 40), F.lit(">")))
        .when(F.col("kind") == "Name", F.concat(F.lit("/"), s))
        .when(F.col("kind") == "Reference", F.concat_ws(" ", F.col("ref_num"), F.col("ref_gen"), F.lit("R")))
        .when(F.col("kind") == "Array", F.format_string("[ %d items ]", "n_children"))
        .when(F.col("kind") == "Dictionary", F.format_string("<< %d entries >>", "n_children"))
        .otherwise(F.format_string("<< stream, %d entries >>", "n_children"))
    )
    return nodes.withColumn("brief", text)


def value_tree(c: Corpus, depth: int = 8) -> DataFrame:
    """The values of every object down to ``depth``, references as leaves."""
    return brief(c.nodes.where(F.col("depth") <= depth))


def _pretty(nodes: list[dict]) -> list[str]:
    """Lines of one object from its values in file order: dictionaries unfold, arrays within them stay on a line."""
    kids: dict = {}
    for n in nodes:
        kids.setdefault(n["parent_ix"], []).append(n)

    def of(n: dict) -> list[str]:
        items = kids.get(n["node_ix"], [])
        if n["kind"] == "Array":
            return ["[", *("  " + line for x in items for line in of(x)), "]"]
        if n["kind"] not in ("Dictionary", "Stream"):
            return [n["full"]]
        lines = ["<<"]
        for x in items:
            if x["kind"] == "Array":
                body = ["[ " + "  ".join(y["brief"] for y in kids.get(x["node_ix"], [])) + " ]"]
            else:
                body = of(x) if x["kind"] == "Dictionary" else [x["brief"]]
            lines += [f"  /{x['key']}  {body[0]}", *("  " + line for line in body[1:])]
        return [*lines, ">>"]

    return [line for n in nodes if n["depth"] == 0 for line in of(n)]


def detail_text(c: Corpus) -> DataFrame:
    """``detail``: every object as indented text; of streams their dictionary and the bytes before and after decoding.

    An object is one row here, as it was in its file.
    """
    from .text import _mapped

    full = F.when(F.col("kind") == "LiteralString", F.concat(F.lit("("), "str_v", F.lit(")"))).when(F.col("kind") == "HexString", F.concat(F.lit("<"), F.hex(F.encode("str_v", "ISO-8859-1")), F.lit(">"))).otherwise(F.col("brief"))
    rows = brief(c.nodes.where("obj_num >= 0")).withColumn("full", full)
    rows = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("node_ix", "parent_ix", "depth", "key", "kind", "brief", "full"))).alias("values"))
    text = _mapped(rows, lambda v: [{"line": x} for x in _pretty(v)], "array<struct<line:string>>", "values")
    size = c.streams.select(*KEY, F.octet_length("stream_raw").alias("n_raw"), F.octet_length("stream_decoded").alias("n_decoded"))
    sizes = F.when(F.col("n_raw").isNotNull(), F.concat_ws("\n", F.lit("stream"), F.format_string("[%d bytes raw]", "n_raw"), F.when(F.col("n_decoded").isNotNull(), F.format_string("[%d bytes decoded]", "n_decoded"))))
    return text.join(size, KEY, "left").select(*KEY, F.concat_ws("\n", F.array_join(F.transform("_r", lambda x: x["line"]), "\n"), sizes).alias("detail"), "error")


def ancestors(nodes: DataFrame) -> DataFrame:
    """``node_ix, above_ix, above_depth`` for every value and each value that holds it.

    Values of an object are numbered depth first, so those that a value holds
    follow it without a gap: as many as lie deeper before the next one of its
    depth or less.  Each depth names the last value met there, which is what a
    deeper value is within.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    order = Window.partitionBy(*KEY).orderBy("node_ix")
    last = F.array(*[F.struct(F.last(F.when(F.col("depth") == d, F.col("node_ix")), ignorenulls=True).over(order).alias("above_ix"), F.lit(d).alias("above_depth")) for d in range(deepest)])
    held = nodes.where("node_ix is not null").select(*KEY, "node_ix", "depth", (last if deepest else F.array().cast("array<struct<above_ix:int,above_depth:int>>")).alias("above"))
    return held.where("depth > 0").select(*KEY, "node_ix", F.inline(F.slice("above", F.lit(1), F.col("depth"))))


def visible_rows(nodes: DataFrame, opened: DataFrame) -> DataFrame:
    """Values seen when only ``opened`` (``KEY, node_ix``) are unfolded, with their ``row`` in the object's order."""
    closed = nodes.select(*KEY, F.col("node_ix").alias("above_ix")).join(opened.select(*KEY, F.col("node_ix").alias("above_ix")), [*KEY, "above_ix"], "left_anti")
    hidden = ancestors(nodes).join(closed, [*KEY, "above_ix"], "left_semi").select(*KEY, "node_ix")
    seen = nodes.join(hidden, [*KEY, "node_ix"], "left_anti")
    return seen.withColumn("row", F.row_number().over(Window.partitionBy(*KEY).orderBy("node_ix")) - 1)


def report(c: Corpus) -> DataFrame:
    """A text report of each file, ``part, ord, line``: facts, index, trailer, and a line for every object.

    ``report(c).orderBy("path", "part", "ord").select("line").write.text(folder)`` keeps it.
    """
    at = ["file_id", "path"]
    facts = c.files.select(*at, F.posexplode(F.array(F.concat(F.lit("file_size : "), "length", F.lit(" bytes")), F.concat(F.lit("pdf_version: "), F.coalesce("version", F.lit("?"))))).alias("ord", "line"))
    n = entry_counts(c)
    total = F.col("n_in_use") + F.col("n_free") + F.col("n_compressed")
    counts = F.array(F.format_string("total entries : %d", total), F.format_string("in-use        : %d", "n_in_use"), F.format_string("free          : %d", "n_free"), F.format_string("compressed    : %d", "n_compressed"))
    index = n.select(*at, F.posexplode(counts).alias("ord", "line"))
    tail = brief(c.trailer()).select(*at, "ord", F.format_string("/%s  %s", "key", "brief").alias("line"))
    size = c.streams.select(*KEY, F.octet_length("stream_raw").alias("n_raw"))
    kinds = F.concat_ws(", ", F.concat(F.lit("Type=/"), "type_name"), F.concat(F.lit("Subtype=/"), "subtype"))
    said = F.concat(
        F.format_string("obj %d %d R  ", "obj_num", "gen"), F.coalesce(F.col("kind"), F.lit("[could not resolve]")), F.when(kinds != "", F.concat(F.lit("  "), kinds)).otherwise(""),
        F.when(F.col("n_raw").isNotNull(), F.format_string("  raw=%dB", "n_raw")).otherwise(""))
    objects = c.objects.join(size, KEY, "left").select(*at, F.col("obj_num").alias("ord"), said.alias("line"))
    parts = (facts, index, tail, objects)
    rows = [p.select(*at, F.lit(i).alias("part"), F.col("ord").cast("int").alias("ord"), "line") for i, p in enumerate(parts)]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def document_tree(c: Corpus) -> DataFrame:
    """Header, Body, XRef and Trailer sections with their lines: ``section, ord, obj_num, label, detail, type_label``."""
    at = ["file_id", "path"]
    head = c.files.select(*at, F.lit("Header").alias("section"), F.lit(0).alias("ord"), F.lit(None).cast("int").alias("obj_num"), F.concat(F.lit("PDF "), "version").alias("label"), F.lit("").alias("detail"))
    body = brief(c.nodes.where("depth = 0 and obj_num >= 0")).select(*at, F.lit("Body"), "obj_num", "obj_num", F.format_string("Object %d %d", "obj_num", "gen"), "brief")
    counts = entry_counts(c)
    xref = counts.select(*at, F.lit("XRef"), F.lit(0), F.lit(None).cast("int"), F.lit("Cross-reference"), F.format_string("%d in use, %d free, %d compressed", "n_in_use", "n_free", "n_compressed"))
    tail = brief(c.trailer()).select(*at, F.lit("Trailer"), "ord", F.lit(None).cast("int"), "key", "brief")
    rows = head.union(body).union(xref).union(tail)
    return rows.join(classify(c).select(*KEY, "type_label"), KEY, "left")


def entry_counts(c: Corpus) -> DataFrame:
    return c.xref.groupBy("file_id", "path").agg(*[F.count_if(F.col("etype") == x).alias(f"n_{x}") for x in ("in_use", "free", "compressed")])


def palette_references(c: Corpus) -> DataFrame:
    """Objects that serve as lookup of an ``[/Indexed base hival ref]`` array, wherever it stands."""
    items = c.nodes.where("key in ('[0]', '[3]')").groupBy("file_id", "path", "obj_num", "parent_ix").agg(
        F.max(F.when((F.col("key") == "[0]") & (F.col("str_v") == "Indexed"), F.lit(True))).alias("indexed"),
        F.max(F.when(F.col("key") == "[3]", F.col("ref_num"))).alias("lookup"),
    )
    return items.where("indexed and lookup is not null").select("file_id", "path", F.col("lookup").alias("obj_num")).distinct()


def link_targets(text: Column) -> Column:
    """Object numbers of the references written in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+)\s+(\d+)\s+R\b"), F.lit(1)), lambda x: x.cast("int"))


def capabilities(c: Corpus) -> DataFrame:
    """What can be shown of each object, as booleans, beside its label."""
    from .text import is_binary, is_content

    refs = c.backrefs.groupBy(*KEY).agg(
        *[F.bool_or((F.col("key_path") == k) & (F.col("type_name") == t)).alias(n) for n, k, t in (
            ("is_ttf", "FontFile2", "FontDescriptor"), ("is_tounicode", "ToUnicode", "Font"), ("is_cid_to_gid_map", "CIDToGIDMap", "Font"), ("is_cid_set", "CIDSet", "FontDescriptor"))],
        F.bool_or(F.col("key_path") == "Thumb").alias("is_thumb"),
    )
    content = owning_pages(c).select(*KEY, F.lit(True).alias("on_page")).distinct()
    body = c.streams.select(*KEY, (is_content(F.col("stream_decoded")) & ~is_binary(F.col("stream_decoded"))).alias("reads_as_content"))
    rows = c.objects.join(refs, KEY, "left").join(content, KEY, "left").join(body, KEY, "left").join(classify(c).select(*KEY, "type_label"), KEY)
    no = F.lit(False)
    image = F.coalesce(F.col("subtype") == "Image", no)
    font = F.coalesce(F.col("type_name") == "Font", no)
    return rows.select(
        *KEY, "gen", "type_label", (image | F.coalesce("is_thumb", no)).alias("is_image"),
        (font & ~F.coalesce(F.col("subtype").isin("Type0", "CIDFontType0", "CIDFontType2"), no)).alias("is_font"),
        (font & F.coalesce(F.col("subtype") == "Type0", no)).alias("is_type0_font"),
        F.coalesce(F.col("type_name") == "FontDescriptor", no).alias("is_font_descriptor"),
        (F.coalesce("on_page", no) | (F.coalesce("reads_as_content", no) & ~image & ~F.coalesce(F.col("type_name").isin("ObjStm", "XRef"), no))).alias("is_content_stream"),
        *[F.coalesce(n, no).alias(n) for n in ("is_ttf", "is_tounicode", "is_cid_to_gid_map", "is_cid_set", "is_thumb")],
        (F.col("type_label") == "ICC Profile").alias("is_icc_profile"), (F.col("type_label") == "Color Palette").alias("is_palette"),
        (F.col("type_label") == "Linearization Hint Stream").alias("is_hint_stream"),
        F.when(image, F.try_element_at("filters", F.lit(1))).alias("image_filter"),
    )
