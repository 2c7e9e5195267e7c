import struct

import pytest

from quire.functions import formats as X


def profile():
    curve = b"curv" + b"\0" * 4 + struct.pack(">IH", 1, 0x0233) + b"\0\0"
    para = b"para" + b"\0" * 4 + struct.pack(">HHi", 0, 0, int(2.4 * 65536))
    xyz = b"XYZ " + b"\0" * 4 + struct.pack(">iii", 65536, 32768, -65536)
    desc = b"desc" + b"\0" * 4 + struct.pack(">I", 5) + b"name\0"
    mluc = b"mluc" + b"\0" * 4 + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", 4, 28) + "hi".encode("utf-16-be")
    table, at, body = [], 132 + 12 * 6, b""
    for sigs, block in ((("rTRC", "gTRC"), curve), (("bTRC",), para), (("wtpt",), xyz), (("desc",), desc), (("cprt",), mluc)):
        gap = 4 if sigs == ("wtpt",) else 0
        body += b"\0" * gap
        table += [(s, at + gap, len(block)) for s in sigs]
        at += gap + len(block)
        body += block
    head = struct.pack(">I", at) + b"\0" * 4 + b"\x02\x40\0\0mntrRGB XYZ " + b"\0" * 12 + b"acsp" + b"\0" * 88
    return head + struct.pack(">I", 6) + b"".join(struct.pack(">4sII", s.encode(), a, n) for s, a, n in table) + body


def test_icc():
    r = X.icc(profile())
    h = r["header"]
    assert (h["profile_class"], h["color_space"], h["pcs"], h["description"], h["copyright"], h["version"]) == ("mntr", "RGB", "XYZ", "name", "hi", "2.4")
    assert h["white_point"] == [1.0, 0.5, -1.0] and h["r_trc"] == [0x233 / 256] and round(h["b_trc"][0], 3) == 2.4
    labels = [s["label"] for s in r["segments"]]
    assert labels == ["Header", "Tag table", "rTRC / gTRC", "bTRC", "Padding", "wtpt", "desc", "cprt"]
    assert all(a["offset"] + a["size"] == b["offset"] for a, b in zip(r["segments"], r["segments"][1:]))
    with pytest.raises(ValueError):
        X.icc(b"short")


def test_jpeg():
    data = (
        b"\xff\xd8" + b"\xff\xe0\x00\x07JFIF\0" + b"\xff\xdb\x00\x43" + b"\0" * 65 + b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00"
        + b"\xff\xc4\x00\x14\x00\x01" + b"\0" * 15 + b"\x05" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"a\xff\x00b\xff\xd0c" + b"\xff\xd9"
    )
    r = X.jpeg(data)
    assert [s["name"] for s in r["segments"]] == ["SOI", "APP0", "DQT", "SOF0", "DHT", "SOS", "scan", "EOI"]
    assert r["frame"] == {"type": "SOF0", "precision": 8, "height": 16, "width": 32, "components": 1}
    assert [s["summary"] for s in r["segments"]][1:6] == ["JFIF", "tables 0", "32x16, 8 bits, 1 components", "tables DC0", "1 components"]
    assert sum(s["size"] for s in r["segments"]) == len(data)


def test_truetype():
    font = X.sfnt({"glyf": b"abc", "head": b"x" * 54, "zzzz": b"1234"})
    assert [(t["tag"], t["length"]) for t in X.ttf_tables(font)] == [("glyf", 3), ("head", 54), ("zzzz", 4)]
    full = X.ttf_complete(font)
    assert {t["tag"] for t in X.ttf_tables(full)} == {"glyf", "head", "zzzz", "name", "cmap", "post"}
    assert all(t["offset"] % 4 == 0 for t in X.ttf_tables(full))


def test_cmap_format_6_to_4():
    six = struct.pack(">HHHHH", 6, 16, 0, 65, 4) + struct.pack(">4H", 5, 6, 0, 9)
    four = X.cmap_6_to_4(six)
    n = struct.unpack(">H", four[6:8])[0] // 2
    ends, starts, deltas = (struct.unpack(f">{n}H", four[at : at + 2 * n]) for at in (14, 16 + 2 * n, 16 + 4 * n))
    assert (ends, starts) == ((66, 68, 0xFFFF), (65, 68, 0xFFFF))
    assert [(65 + deltas[0]) & 0xFFFF, (68 + deltas[1]) & 0xFFFF] == [5, 9] and struct.unpack(">H", four[2:4])[0] == len(four)


def test_cmap():
    m = X.cmap(b"/CMapName /T def /Registry (Adobe) 1 beginbfchar <03> <D83DDE00> endbfchar 2 beginbfrange <01> <03> <0041> <05> <06> [<0061> <0062>] endbfrange")
    assert [(r["src_int"], r["char"]) for r in m["rows"]] == [(1, "A"), (2, "B"), (3, "😀"), (3, "C"), (5, "a"), (6, "b")]
    assert (m["name"], m["registry"]) == ("T", "Adobe")


def test_cid_tables():
    assert X.cid_to_gid(bytes.fromhex("0000000300000007")) == [(1, 3), (3, 7)]
    s = X.cid_set(b"\x81\x00")
    assert (s["total_slots"], s["present_count"], s["last_cid"], s["coverage_hex"]) == (16, 2, 7, "8100")


def test_glyphs_and_encodings():
    assert [X.glyph_char(n) for n in ("A", "eacute", "germandbls", "uni20AC", "Zcaron", "nosuch", "five")] == ["A", "é", "ß", "€", "Ž", "?", "5"]
    assert X.encoding("WinAnsiEncoding")[0x80] == "€" and X.encoding(None)[0xE9] == "é" and len(X.encoding(None)) == 224
    assert X.differences([65, "a", "b", 70, "c"]) == {65: "a", 66: "b", 70: "c"}


class Packer:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += f"{v:0{n}b}" if n else ""

    def end(self):
        self.bits += "0" * (-len(self.bits) % 8)

    def bytes(self):
        self.end()
        return int("1" + self.bits, 2).to_bytes(len(self.bits) // 8 + 1, "big")[1:]


def test_hint_tables():
    p = Packer()
    for (_, w), v in zip(X.PAGE_HEADER, (2, 100, 3, 50, 5, 0, 0, 0, 0, 2, 4, 0, 1)):
        p.put(v, w)
    for row, w in (((1, 4), 3), ((7, 20), 5), ((0, 2), 2), ((0, 2), 4)):
        for v in row:
            p.put(v, w)
        p.end()
    at = len(p.bytes())
    for (_, w), v in zip(X.SHARED_HEADER, (20, 900, 1, 3, 2, 10, 4)):
        p.put(v, w)
    for row, w in (((1, 2, 3), 4), ((0, 1, 0), 1)):
        for v in row:
            p.put(v, w)
        p.end()
    p.put(0, 128)
    for v in (1, 0, 2):
        p.put(v, 2)
    r = X.hint_tables(p.bytes(), 2, at, 7)
    assert [(x["nobjects"], x["page_length"], x["nshared"], x["shared_ids"]) for x in r["pages"]] == [(3, 57, 0, []), (6, 70, 2, [0, 2])]
    assert [(g["first_obj"], g["nobjects"], g["group_length"], g["section"]) for g in r["shared_groups"]] == [(7, 2, 11, "first_page"), (20, 1, 12, "rest"), (21, 3, 13, "rest")]
    with pytest.raises(ValueError):
        X.hint_tables(p.bytes()[:20], 2, at, 7)


def test_ccitt():
    assert [X.ccitt(k)["compression_short"] for k in (-1, 0, 4)] == ["G4", "G3-1D", "G3-2D"]
