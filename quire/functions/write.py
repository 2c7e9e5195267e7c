"""PDF bytes from values: object writer, cross-reference tables and streams, and the generated layouts of the tests."""

from __future__ import annotations

import re
import struct
import zlib
from typing import Any

from .codecs import png_do
from .lexer import Value


def dictionary(**entries: Any) -> Value:
    return Value("Dictionary", {k: v if isinstance(v, Value) else wrap(v) for k, v in entries.items()})


def wrap(v: Any) -> Value:
    if isinstance(v, bool):
        return Value("Boolean", v)
    if isinstance(v, int):
        return Value("Integer", v)
    if isinstance(v, float):
        return Value("Real", v)
    if isinstance(v, list):
        return Value("Array", [x if isinstance(x, Value) else wrap(x) for x in v])
    return Value("Null") if v is None else Value("Name", v)


def ref(num: int) -> Value:
    return Value("Reference", (num, 0))


def _name(text: str) -> bytes:
    return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], text.encode("latin-1", "replace"))


def escape(raw: bytes) -> bytes:
    return raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def real(x: float) -> bytes:
    """Plain decimal notation with at least one decimal; PDF has no exponents."""
    text = f"{x:.10f}".rstrip("0")
    return (text + "0" if text.endswith(".") else text).encode()


def body(v: Value) -> bytes:
    k, d = v.kind, v.data
    if k == "Boolean":
        return b"true" if d else b"false"
    if k == "Integer":
        return b"%d" % d
    if k == "Real":
        return real(d)
    if k == "Name":
        return _name(d)
    if k == "LiteralString":
        return b"(" + escape(d.encode("latin-1", "replace")).replace(b"\r", b"\\r") + b")"
    if k == "HexString":
        return b"<" + d.encode("latin-1").hex().upper().encode() + b">"
    if k == "Reference":
        return b"%d %d R" % d
    if k == "Array":
        return b"[" + b" ".join(map(body, d)) + b"]"
    if k == "Dictionary":
        return b"<<" + b" ".join(_name(n) + b" " + body(x) for n, x in d.items()) + b">>"
    if k == "Stream":
        entries = d[0] | {"Length": Value("Integer", len(d[1]))}
        return body(Value("Dictionary", entries)) + b"\nstream\n" + d[1] + b"\nendstream"
    return b"null"


def indirect(num: int, v: Value, gen: int = 0) -> bytes:
    return b"%d %d obj\n%s\nendobj\n" % (num, gen, body(v))


def stream(data: bytes, filters: tuple[str, ...] = ("FlateDecode",), **entries: Any) -> Value:
    from .codecs import encode_chain

    if filters:
        entries["Filter"] = wrap(filters[0]) if len(filters) == 1 else wrap(list(filters))
    return Value("Stream", (dictionary(**entries).data, encode_chain(data, list(filters)), 0))


HEADER = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"


def table_entry(offset: int, gen: int, kind: bytes) -> bytes:
    return b"%010d %05d %s\r\n" % (offset, gen, kind)


def xref_table(offsets: dict[int, tuple[int, int]], size: int) -> bytes:
    """A classic section from 0 to ``size``; missing numbers are free."""
    rows = [table_entry(0, 65535, b"f")]
    rows += [table_entry(*offsets[n], b"n") if n in offsets else table_entry(0, 0, b"f") for n in range(1, size)]
    return b"xref\n0 %d\n" % size + b"".join(rows)


def xref_stream(num: int, rows: list[tuple[int, int, int]], trailer: dict[str, Value], predictor: int = 0, widths=(1, 4, 2)) -> Value:
    """An xref stream whose entry ``i`` is ``rows[i]``; its own entry is among them."""
    data = b"".join(b"".join(x.to_bytes(w, "big") for x, w in zip(r, widths)) for r in rows)
    entries = {"Type": wrap("XRef"), "Size": wrap(len(rows)), "W": wrap(list(widths)), **trailer, "Filter": wrap("FlateDecode")}
    if predictor >= 10:
        entries["DecodeParms"] = dictionary(Predictor=predictor, Columns=sum(widths))
        data = png_do(data, sum(widths))
    return Value("Stream", (entries, zlib.compress(data), 0))


def object_stream(members: list[tuple[int, Value]]) -> Value:
    return packed_stream([n for n, _ in members], [body(v) for _, v in members])


def packed_stream(numbers: list[int], parts: list[bytes]) -> Value:
    """An object stream of values that are bytes already."""
    at, head = 0, []
    for num, p in zip(numbers, parts):
        head.append(b"%d %d" % (num, at))
        at += len(p) + 1
    top = b" ".join(head) + b"\n"
    return stream(top + b"\n".join(parts), Type="ObjStm", N=len(numbers), First=len(top))


def page_content(text: str, leading: int = 0) -> bytes:
    lines = [b"BT", b"/F1 12 Tf"] + ([b"%d TL" % leading] if leading else []) + [b"72 720 Td"]
    for line in text.split("\n"):
        lines += [b"(" + escape(line.encode("latin-1", "replace")) + b") Tj", b"T*"]
    return b"\n".join([*lines, b"ET", b""])


def page_objects(text: str, lang: str, source: str, leading: int = 0) -> list[tuple[int, Value]]:
    return [
        (1, dictionary(Type="Catalog", Pages=ref(2))),
        (2, dictionary(Type="Pages", Kids=[ref(3)], Count=1)),
        (3, dictionary(Type="Page", Parent=ref(2), MediaBox=[0, 0, 612, 792], Contents=ref(4), Resources=dictionary(Font=dictionary(F1=ref(5))))),
        (4, stream(page_content(text, leading))),
        (5, dictionary(Type="Font", Subtype="Type1", BaseFont="Helvetica")),
        (6, dictionary(Title=Value("LiteralString", lang), Author=Value("LiteralString", source))),
    ]


def assemble(objects: list[tuple[int, Value]], trailer: dict[str, Value]) -> bytes:
    """A file with a classic cross-reference table."""
    out, at, offsets = [HEADER], len(HEADER), {}
    for num, v in objects:
        offsets[num] = (at, 0)
        out.append(indirect(num, v))
        at += len(out[-1])
    size = max(offsets) + 1
    out.append(xref_table(offsets, size))
    out.append(b"trailer\n" + body(Value("Dictionary", {"Size": wrap(size), **trailer})) + b"\nstartxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)


def assemble_packed(objects: list[tuple[int, Value]], members: list[tuple[int, Value]], trailer: dict[str, Value], predictor: int = 0) -> bytes:
    """A file whose ``members`` lie in an object stream, with a cross-reference stream."""
    top = max(n for n, _ in [*objects, *members])
    host, own = top + 1, top + 2
    out, at, rows = [HEADER], len(HEADER), [(0, 0, 65535)] + [(0, 0, 0)] * (own)
    for num, v in [*objects, (host, object_stream(members))]:
        rows[num] = (1, at, 0)
        out.append(indirect(num, v))
        at += len(out[-1])
    for i, (num, _) in enumerate(members):
        rows[num] = (2, host, i)
    rows[own] = (1, at, 0)
    out.append(indirect(own, xref_stream(own, rows, trailer, predictor)))
    out.append(b"startxref\n%d\n%%%%EOF\n" % at)
    return b"".join(out)


def typeset(lang: str, source: str) -> bytes:
    """A line in two fonts: ``lang`` in a simple one whose map gives capitals, ``source`` in a composite one with codes from 0x1000."""
    codes = b"".join(b"%04X" % (0x1000 + x) for x in source.encode("latin-1", "replace"))
    content = b"BT /F1 10 Tf 72 720 Td (%s) Tj /F2 10 Tf <%s> Tj /F1 10 Tf (z) Tj ET" % (escape(lang.encode("latin-1", "replace")), codes)
    upper, wide = b"1 beginbfrange <61> <7A> <0041> endbfrange", b"1 beginbfrange <1000> <10FF> <0000> endbfrange"
    objects = [
        *page_objects("", lang, source)[:2],
        (3, dictionary(Type="Page", Parent=ref(2), MediaBox=[0, 0, 612, 792], Contents=ref(4), Resources=dictionary(Font=dictionary(F1=ref(5), F2=ref(7))))),
        (4, stream(content)),
        (5, dictionary(Type="Font", Subtype="TrueType", BaseFont="Simple", FirstChar=32, LastChar=255, Widths=[600] * 224, ToUnicode=ref(9))),
        page_objects("", lang, source)[5],
        (7, dictionary(Type="Font", Subtype="Type0", BaseFont="Wide", Encoding="Identity-H", DescendantFonts=[ref(8)], ToUnicode=ref(10))),
        (8, dictionary(Type="Font", Subtype="CIDFontType2", BaseFont="Wide", DW=900, W=[0x1000, 0x106D, 700, 0x106E, [700] * 13, 0x107B, 0x10FF, 700.0])),
        (9, stream(upper)),
        (10, stream(wide)),
    ]
    return assemble(objects, TRAILER)


def picture(pixels: bytes) -> bytes:
    """A page with an image of a row of grey samples and the same row through a palette that turns them over."""
    n = len(pixels)
    size = {"Type": "XObject", "Subtype": "Image", "Width": n, "Height": 1, "BitsPerComponent": 8}
    objects = [
        *page_objects("", "", "")[:2],
        (3, dictionary(Type="Page", Parent=ref(2), MediaBox=[0, 0, 612, 792], Resources=dictionary(XObject=dictionary(A=ref(4), B=ref(5))))),
        (4, stream(pixels, **size, ColorSpace="DeviceGray")),
        (5, stream(pixels, **size, ColorSpace=ref(7))),
        page_objects("", "", "")[5],
        (7, Value("Array", [wrap("Indexed"), wrap("DeviceRGB"), wrap(255), ref(8)])),
        (8, stream(b"".join(bytes([255 - i] * 3) for i in range(256)))),
    ]
    return assemble(objects, TRAILER)


def inheriting(text: str) -> bytes:
    """A page for each line under three levels of nodes, whose attributes they inherit.

    The root has a media box, resources and a rotation; the first of its two
    branches a media box of its own, the second other resources by reference and
    a crop box.  Lines go to the branches in turn; every third page has a
    rotation of its own.
    """
    lines = text.split("\n")
    fonts = [(5, dictionary(Type="Font", Subtype="Type1", BaseFont="Upper")), (6, dictionary(Type="Font", Subtype="Type1", BaseFont="Lower"))]
    number, objects, kids = 10, [], {7: [], 8: []}
    for i, line in enumerate(lines):
        up = 7 + i % 2
        page = {"Type": "Page", "Parent": ref(up), "Contents": ref(number + 1)} | ({"Rotate": 180} if i % 3 == 0 else {})
        objects += [(number, dictionary(**page)), (number + 1, stream(page_content(line)))]
        kids[up].append(ref(number))
        number += 2
    top = {"MediaBox": [0, 0, 600, 800], "Rotate": 90, "Resources": dictionary(Font=dictionary(F1=ref(5)))}
    tree = [
        (1, dictionary(Type="Catalog", Pages=ref(2))),
        (2, dictionary(Type="Pages", Kids=[ref(3)], Count=len(lines), **top)),
        (3, dictionary(Type="Pages", Parent=ref(2), Kids=ref(4), Count=len(lines))),
        (4, Value("Array", [ref(7), ref(8)])),
        (7, dictionary(Type="Pages", Parent=ref(3), Kids=kids[7], Count=len(kids[7]), MediaBox=[0, 0, 300, 400.5])),
        (8, dictionary(Type="Pages", Parent=ref(3), Kids=kids[8], Count=len(kids[8]), Resources=ref(9), CropBox=[10, 10, 90, 110])),
        (9, dictionary(Font=dictionary(F1=ref(6)))),
    ]
    return assemble(sorted([*tree, *fonts, *objects], key=lambda o: o[0]), {"Root": ref(1)})


def mixed_codes(source: str) -> bytes:
    """``source`` in codes of one and two bytes in turn, whose map uses another, and then a word in a predefined map.

    Characters from the space to the tilde; one-byte codes are the characters, two-byte codes 0x8140 and on.
    """
    raw = bytes(b for b in source.encode("latin-1", "replace") if 32 <= b < 127)
    codes = b"".join(b"%02X" % b if i % 2 == 0 else b"81%02X" % (b + 32) for i, b in enumerate(raw))
    content = b"BT /F1 10 Tf 72 720 Td <%s> Tj (A) Tj /F2 10 Tf (A) Tj /F3 10 Tf <00410042> Tj ET" % codes
    used = b"1 begincodespacerange <8140> <FEFE> endcodespacerange 1 begincidrange <8140> <819E> 1000 endcidrange"
    own = b"/Base usecmap 1 begincodespacerange <00> <7F> endcodespacerange 1 begincidrange <20> <7E> 0 endcidrange"
    to_text = b"2 beginbfrange <20> <7E> <0020> <8140> <819E> <0020> endbfrange"
    wide = lambda kid, **e: dictionary(Type="Font", Subtype="Type0", BaseFont="W", DescendantFonts=[ref(kid)], **e)
    objects = [
        *page_objects("", "", source)[:2],
        (3, dictionary(Type="Page", Parent=ref(2), MediaBox=[0, 0, 612, 792], Contents=ref(4), Resources=dictionary(Font=dictionary(F1=ref(5), F2=ref(7), F3=ref(8))))),
        (4, stream(content)),
        (5, wide(9, Encoding=ref(10), ToUnicode=ref(12))),
        page_objects("", "", source)[5],
        (7, wide(9, Encoding="90ms-RKSJ-H")),
        (8, wide(9, Encoding="UniJIS-UTF16-H")),
        (9, dictionary(Type="Font", Subtype="CIDFontType0", BaseFont="W", DW=700, W=[0, 94, 500, 1000, 1094, 1000])),
        (10, stream(own, Type="CMap", UseCMap=ref(11))),
        (11, stream(used, Type="CMap")),
        (12, stream(to_text)),
    ]
    return assemble(objects, TRAILER)


def scans(text: str) -> bytes:
    """The bytes of ``text`` as black and white pixels, 256 a row and a third of the rows in each CCITT scheme, and as a grey JPEG of 32 pixels a row."""
    from . import fax, jpeg

    raw = text.encode("utf-8")
    raw = raw.ljust(max(1, -(-len(raw) // 96)) * 96, b" ")
    rows = [raw[i : i + 32] for i in range(0, len(raw), 32)]
    third = len(rows) // 3
    size = {"Type": "XObject", "Subtype": "Image", "ColorSpace": "DeviceGray"}

    def image(data: bytes, **entries: Any) -> Value:
        return Value("Stream", (dictionary(**size, **entries).data, data, 0))

    bits = lambda i, k: image(fax.encode(rows[i * third : (i + 1) * third], 256, k), Width=256, Height=third, BitsPerComponent=1, Filter="CCITTFaxDecode", DecodeParms=dictionary(K=k, Columns=256, BlackIs1=True))
    objects = [
        *page_objects("", "", "")[:2],
        (3, dictionary(Type="Page", Parent=ref(2), MediaBox=[0, 0, 612, 792], Resources=dictionary(XObject=dictionary(A=ref(4), B=ref(5), C=ref(7), D=ref(8))))),
        (4, bits(0, -1)),
        (5, bits(1, 0)),
        page_objects("", "", "")[5],
        (7, bits(2, 4)),
        (8, image(jpeg.encode(raw, 32, len(rows)), Width=32, Height=len(rows), BitsPerComponent=8, Filter="DCTDecode")),
    ]
    return assemble(objects, TRAILER)


def icc_profile(description: str, white: float) -> bytes:
    """A small RGB profile: a curve that two channels share, four bytes of padding, a white point and a description."""
    s15 = lambda *v: struct.pack(f">{len(v)}i", *(round(x * 65536) for x in v))
    curve = b"curv" + bytes(4) + struct.pack(">IH", 1, 0x0233) + bytes(2)
    name = description.encode("latin-1", "replace") + b"\0"
    desc = b"desc" + bytes(4) + struct.pack(">I", len(name)) + name
    blocks = [(("rTRC", "gTRC"), 0, curve), (("wtpt",), 4, b"XYZ " + bytes(4) + s15(white, 1.0, 0.5)), (("desc",), 0, desc)]
    at, table, out = 132 + 12 * 4, b"", b""
    for names, gap, block in blocks:
        table += b"".join(struct.pack(">4sII", n.encode(), at + gap, len(block)) for n in names)
        at += gap + len(block)
        out += bytes(gap) + block
    head = struct.pack(">I", at) + bytes(4) + b"\x02\x40\0\0mntrRGB XYZ " + bytes(12) + b"acsp" + bytes(88)
    return head + struct.pack(">I", 4) + table + out


def rich(text: str, lang: str, source: str) -> bytes:
    """A page with a TrueType and a composite font, a colour profile, and images of four kinds made from ``text``."""
    from . import fax, jpeg
    from .formats import sfnt

    raw = text.encode("utf-8")
    part = (raw[:60] + b"   ")[: max(3, min(60, len(raw)) // 3 * 3)]
    n = len(source)
    differences = [65, wrap("eacute"), wrap("germandbls"), 97, wrap("Euro")]
    content = b"q 100 0 0 -50 10 20 cm /Im1 Do Q q 30 0 0 40 0 0 cm /Im2 Do Q BT /F1 10 Tf 3 Tr (ABa) Tj ET"
    resources = dictionary(Font=dictionary(F1=ref(5), F2=ref(12)), XObject=dictionary(Im1=ref(20), Im2=ref(21), Im3=ref(22), Im4=ref(23)), ColorSpace=dictionary(C=ref(17)))
    image = {"Type": "XObject", "Subtype": "Image", "Height": 1}
    triples = [part[i : i + 3] for i in range(0, len(part), 3)]
    steps = b"".join(bytes((a - b) & 255 for a, b in zip(t, before)) for t, before in zip(triples, [bytes(3), *triples]))
    as_is = lambda data, **e: Value("Stream", (dictionary(**image, **e).data, data, 0))
    objects = [
        *page_objects("", lang, source)[:2],
        (3, dictionary(Type="Page", Parent=ref(2), MediaBox=[0, 0, 612, 792], Contents=ref(4), Resources=resources)),
        (4, stream(content)),
        (5, dictionary(Type="Font", Subtype="TrueType", BaseFont="Simple", FirstChar=65, LastChar=66, Widths=[600, 700], FontDescriptor=ref(10), Encoding=dictionary(Type="Encoding", Differences=differences))),
        page_objects("", lang, source)[5],
        (10, dictionary(Type="FontDescriptor", FontName="Simple", Flags=4 | 64 * (n % 2), Ascent=len(raw), Descent=-200, ItalicAngle=-12.5, StemV=80, FontBBox=[0, -200, 1000, 900], FontFile2=ref(13), CIDSet=ref(14))),
        (11, stream(b"/CMapName /T def 1 beginbfrange <0001> <%04X> <0041> endbfrange" % max(1, n))),
        (12, dictionary(Type="Font", Subtype="Type0", BaseFont="Wide", Encoding="Identity-H", DescendantFonts=[ref(15)], ToUnicode=ref(11))),
        (13, stream(sfnt({"glyf": raw, "head": bytes(54), "maxp": bytes(6)}), Length1=len(raw))),
        (14, stream(int("1" * (n + 1) + "0" * (-(n + 1) % 8), 2).to_bytes((n + 8) // 8, "big"))),
        (15, dictionary(Type="Font", Subtype="CIDFontType2", BaseFont="Wide", DW=750, CIDToGIDMap=ref(16), CIDSystemInfo=dictionary(Registry=Value("LiteralString", "Adobe"), Ordering=Value("LiteralString", "Identity"), Supplement=n))),
        (16, stream(struct.pack(f">{n + 1}H", *(2 * i for i in range(n + 1))))),
        (17, Value("Array", [wrap("ICCBased"), ref(18)])),
        (18, stream(icc_profile(source, 0.5 + len(lang) / 64), N=3)),
        (20, stream(part, **image, Width=2 * len(part), BitsPerComponent=4, ColorSpace="DeviceGray")),
        (21, stream(steps, **image, Width=len(triples), BitsPerComponent=8, ColorSpace=ref(17), DecodeParms=dictionary(Predictor=2, Colors=3, Columns=len(triples)))),
        (22, as_is(jpeg.encode(part, len(part), 1), Width=len(part), BitsPerComponent=8, ColorSpace="DeviceGray", Filter="DCTDecode")),
        (23, as_is(fax.encode([part], 8 * len(part)), Width=8 * len(part), BitsPerComponent=1, ImageMask=True, Filter="CCITTFaxDecode", DecodeParms=dictionary(K=-1, Columns=8 * len(part), BlackIs1=True))),
    ]
    return assemble(objects, TRAILER)


def hint_stream(lengths: list[int], first: int) -> tuple[bytes, int]:
    """Hint tables of pages of these lengths and of three shared groups, and where the second table begins.

    Page ``i`` has 2 + i % 4 objects and, if ``i`` is odd, uses the shared group i % 3.
    """
    from .formats import PAGE_HEADER, SHARED_HEADER

    rows: list[str] = []

    def put(*fields: tuple[int, int]) -> None:
        bits = "".join(f"{v:0{w}b}" if w else "" for v, w in fields)
        rows.append(bits + "0" * (-len(bits) % 8))

    n = len(lengths)
    put(*((v, w) for (_, w), v in zip(PAGE_HEADER, (2, 0, 2, 50, 32, 0, 0, 0, 0, 1, 4, 0, 1))))
    put(*((i % 4, 2) for i in range(n)))
    put(*((x - 50, 32) for x in lengths))
    put(*((i % 2, 1) for i in range(n)))
    put(*((i % 3, 4) for i in range(n) if i % 2))
    at = sum(map(len, rows)) // 8
    put(*((v, w) for (_, w), v in zip(SHARED_HEADER, (first + 10, 900, 1, 3, 2, 10, 4))))
    put((1, 4), (2, 4), (3, 4))
    put((0, 1), (0, 1), (0, 1))
    put((1, 2), (0, 2), (2, 2))
    bits = "".join(rows)
    return int(bits, 2).to_bytes(len(bits) // 8, "big"), at


def linearized(text: str) -> bytes:
    """A page for each line, with the index, the parameters and the hints of a linearized file before them."""
    lines = text.split("\n")
    n, first = len(lines), 6
    pages = [(first + 2 * i, page_content(line)) for i, line in enumerate(lines)]
    hints, shared_at = hint_stream([50 + len(x) for x in lines], first)
    size = first + 2 * n
    objects = [(3, stream(hints, S=shared_at)), (4, dictionary(Type="Catalog", Pages=ref(5))), (5, dictionary(Type="Pages", Kids=[ref(k) for k, _ in pages], Count=n))]
    for k, content in pages:
        objects += [(k, dictionary(Type="Page", Parent=ref(5), MediaBox=[0, 0, 612, 792], Contents=ref(k + 1))), (k + 1, stream(content))]
    written = {k: indirect(k, v) for k, v in objects}
    head = lambda *v: b"1 0 obj\n<</Linearized 1 /L %010d /H [%010d %010d] /O %d /E %010d /N %d /T %010d>>\nendobj\n" % v
    parameters_at = len(HEADER)
    index_at = parameters_at + len(head(0, 0, 0, first, 0, n, 0))
    body_at = index_at + len(xref_table({}, size)) + len(b"trailer\n") + len(body(dictionary(Size=size, Root=ref(4)))) + len(b" /Prev 0000000000") + len(b"\nstartxref\n0\n%%EOF\n")
    at, offsets = body_at, {1: (parameters_at, 0)}
    for k, _ in objects:
        offsets[k] = (at, 0)
        at += len(written[k])
    trailer = body(dictionary(Size=size, Root=ref(4)))[:-2] + b" /Prev %010d>>" % at
    first_index = xref_table(offsets, size) + b"trailer\n" + trailer + b"\nstartxref\n0\n%%EOF\n"
    end_of_first = offsets[first + 2][0] if n > 1 else at
    tail = b"xref\n0 1\n" + table_entry(0, 65535, b"f") + b"trailer\n" + body(dictionary(Size=1)) + b"\nstartxref\n%d\n%%%%EOF\n" % index_at
    whole = head(at + len(tail), offsets[3][0], len(written[3]), first, end_of_first, n, at)
    return b"".join((HEADER, whole, first_index, *(written[k] for k, _ in objects), tail))


def nested_forms(lang: str, source: str) -> bytes:
    """A page that draws a form twice, which draws another twice, which draws itself.

    The inner form shows ``source`` and a line, the outer one ``lang``; the outer
    has a matrix of its own and resources that name the inner one, the inner one
    has none and uses those of the page.
    """
    show = lambda s: b"BT /F1 10 Tf 1 2 Td (%s) Tj ET" % escape(s.encode("latin-1", "replace"))
    page = b"q 1 0 0 1 100 200 cm /Outer Do Q q 2 0 0 2 0 0 cm /Outer Do Q /Image Do 0 0 m 9 9 l S"
    outer = show(lang) + b" q 1 0 0 1 0 50 cm /Alias Do Q q 0 1 -1 0 5 0 cm /Alias Do Q 1 1 3 3 re f"
    inner = show(source) + b" 0 0 m 5 5 l S /Self Do"
    form = {"Type": "XObject", "Subtype": "Form", "BBox": [0, 0, 100, 100]}
    names = dictionary(Outer=ref(7), Self=ref(8), Image=ref(9))
    objects = [
        *page_objects("", lang, source)[:2],
        (3, dictionary(Type="Page", Parent=ref(2), MediaBox=[0, 0, 612, 792], Contents=ref(4), Resources=dictionary(Font=dictionary(F1=ref(5)), XObject=names))),
        (4, stream(page)),
        (5, dictionary(Type="Font", Subtype="Type1", BaseFont="Helvetica")),
        page_objects("", lang, source)[5],
        (7, stream(outer, Matrix=[1, 0, 0, 1, 10, 0], Resources=dictionary(XObject=dictionary(Alias=ref(8), Image=ref(8))), **form)),
        (8, stream(inner, **form)),
        (9, stream(b"\0", Type="XObject", Subtype="Image", Width=1, Height=1, BitsPerComponent=8, ColorSpace="DeviceGray")),
    ]
    return assemble(objects, TRAILER)


TRAILER = {"Root": ref(1), "Info": ref(6)}


def book(text: str, lang: str, source: str, fan: int = 4) -> bytes:
    """A page for each line, under a page tree of ``fan`` kids a node; contents of every page in an array of two streams."""
    lines = text.split("\n")
    objects = [(1, dictionary(Type="Catalog", Pages=ref(2))), (5, dictionary(Type="Font", Subtype="Type1", BaseFont="Helvetica")), (6, page_objects("", lang, source)[5][1])]
    number, level = 7, []
    for line in lines:
        half = len(line) // 2
        parts = [(number + 1, stream(page_content(line[:half]))), (number + 2, stream(page_content(line[half:])))]
        page = {"Type": "Page", "MediaBox": [0, 0, 612, 792], "Contents": [ref(n) for n, _ in parts], "Resources": dictionary(Font=dictionary(F1=ref(5)))}
        level.append((number, page, 1))
        objects += parts
        number += 3
    while True:
        top = len(level) <= fan
        above = []
        for i in range(0, len(level), fan):
            own, kids = 2 if top else number, level[i : i + fan]
            number += not top
            objects += [(n, dictionary(**d, Parent=ref(own))) for n, d, _ in kids]
            above.append((own, {"Type": "Pages", "Kids": [ref(n) for n, _, _ in kids], "Count": sum(c for _, _, c in kids)}, sum(c for _, _, c in kids)))
        if top:
            objects.append((2, dictionary(**above[0][1])))
            return assemble(sorted(objects, key=lambda o: o[0]), TRAILER)
        level = above


def updated(data: bytes, num: int, value: Value, size: int) -> bytes:
    """``data`` with an incremental update: object ``num`` anew, and a section of its own that names the one before."""
    before = int(data.rpartition(b"startxref")[2].split()[0])
    at = len(data)
    body_ = indirect(num, value)
    section = b"xref\n%d 1\n%010d 00000 n \n" % (num, at)
    end = b"trailer\n" + body(Value("Dictionary", {"Size": wrap(size), **TRAILER, "Prev": wrap(before)})) + b"\nstartxref\n%d\n%%%%EOF\n" % (at + len(body_))
    return data + body_ + section + end


def layout(kind: str, text: str | None, lang: str | None, source: str | None) -> bytes:
    """A file of a text: one page as ``lay1``, ``lay2`` (packed), ``lay2p`` (packed, predictor 12), ``lay3`` (with leading)
    or ``lay4`` (its information dictionary updated twice), or ``book``, a page a line; ``type`` (two fonts), ``image``, ``inherit`` (attributes along the page tree) ``forms`` (nested), ``codes`` (of mixed width) ``scans`` (CCITT and JPEG), ``rich`` (fonts, a profile, images) or ``linear`` (a page a line, linearized)."""
    if kind == "type":
        return typeset(lang or "", source or "")
    if kind == "image":
        return picture((text or "").encode("utf-8")[:64] or b"\0")
    if kind == "rich":
        return rich(text or "", lang or "", source or "")
    if kind == "linear":
        return linearized(text or "")
    if kind == "scans":
        return scans(text or "")
    if kind == "codes":
        return mixed_codes(source or "")
    if kind == "forms":
        return nested_forms(lang or "", source or "")
    if kind == "inherit":
        return inheriting(text or "")
    if kind == "book":
        return book(text or "", lang or "", source or "")
    if kind == "lay4":
        data = layout("lay1", text, lang, source)
        for title in ("first edit", "second edit"):
            data = updated(data, 6, dictionary(Title=Value("LiteralString", title), Author=Value("LiteralString", source or "")), 7)
        return data
    objects = page_objects(text or "", lang or "", source or "", 14 if kind == "lay3" else 0)
    if kind in ("lay1", "lay3"):
        return assemble(objects, TRAILER)
    return assemble_packed(objects[:4], objects[4:], TRAILER, 12 if kind == "lay2p" else 0)
