"""Readers of the binary formats that PDF files carry: ICC, JPEG, TrueType, CMap, CID tables, hint tables, CCITT."""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import accumulate

# ---------------------------------------------------------------- ICC

# Names of common ICC tags.
ICC_TAGS = {
    "desc": "Profile description", "cprt": "Copyright", "wtpt": "Media white point", "bkpt": "Media black point", "rXYZ": "Red primary",
    "gXYZ": "Green primary", "bXYZ": "Blue primary", "rTRC": "Red tone curve", "gTRC": "Green tone curve", "bTRC": "Blue tone curve",
    "kTRC": "Grey tone curve", "dmnd": "Manufacturer", "dmdd": "Device model", "vued": "Viewing conditions", "view": "Viewing conditions data",
    "lumi": "Luminance", "meas": "Measurement", "tech": "Technology", "chad": "Chromatic adaptation", "A2B0": "Device to PCS", "B2A0": "PCS to device",
}
#: Parameters of each ICC parametric curve type.
_PARA = (1, 3, 4, 5, 7)


def s15(raw: bytes) -> float:
    return struct.unpack(">i", raw)[0] / 65536


def _ascii(raw: bytes) -> str:
    return raw.decode("latin-1").rstrip("\0 ")


def icc_text(block: bytes) -> str | None:
    """Text of a desc, text or mluc block."""
    kind = block[:4]
    if kind == b"desc":
        n = struct.unpack(">I", block[8:12])[0]
        return _ascii(block[12 : 12 + n])
    if kind == b"text":
        return _ascii(block[8:])
    if kind == b"mluc" and len(block) >= 28:
        n, at = struct.unpack(">II", block[20:28])
        return block[at : at + n].decode("utf-16-be", "replace")
    return None


def icc_curve(block: bytes) -> list[float] | None:
    """Gamma, parameters, or sampled points of a tone curve."""
    kind = block[:4]
    if kind == b"curv":
        n = struct.unpack(">I", block[8:12])[0]
        if n == 0:
            return [1.0]
        if n == 1:
            return [struct.unpack(">H", block[12:14])[0] / 256]
        n = min(n, (len(block) - 12) // 2)
        return [x / 65535 for x in struct.unpack(f">{n}H", block[12 : 12 + 2 * n])]
    if kind == b"para":
        n = struct.unpack(">H", block[8:10])[0]
        return [s15(block[12 + 4 * i : 16 + 4 * i]) for i in range(_PARA[n] if n < len(_PARA) else 0)]
    return None


def _icc_summary(block: bytes) -> str:
    kind = _ascii(block[:4])
    if (text := icc_text(block)) is not None:
        return text
    if kind == "XYZ" and len(block) >= 20:
        return "X={:.4f} Y={:.4f} Z={:.4f}".format(*(s15(block[8 + 4 * i : 12 + 4 * i]) for i in range(3)))
    if (curve := icc_curve(block)) is not None:
        return f"gamma {curve[0]:.4f}" if len(curve) == 1 else f"{len(curve)} values"
    return f"{len(block)} bytes"


def icc(data: bytes) -> dict:
    """Header, tag rows, and the byte ranges of the profile with padding between blocks."""
    if len(data) < 132 or data[36:40] != b"acsp":
        raise ValueError("not an ICC profile")
    count = struct.unpack(">I", data[128:132])[0]
    tags, blocks = [], {}
    for i in range(min(count, (len(data) - 132) // 12)):
        sig, at, size = struct.unpack(">4sII", data[132 + 12 * i : 144 + 12 * i])
        block = data[at : at + size]
        name = _ascii(sig)
        tags.append({"sig": name, "name": ICC_TAGS.get(name, name), "type_sig": _ascii(block[:4]), "offset": at, "size": size, "summary": _icc_summary(block)})
        labels, longest = blocks.get(at, ([], 0))
        blocks[at] = ([*labels, name], max(longest, size))
    parts = [("Header", 0, 128), ("Tag table", 128, 4 + 12 * len(tags))]
    end = 132 + 12 * len(tags)
    for at, (labels, size) in sorted(blocks.items()):
        if at > end:
            parts.append(("Padding", end, at - end))
        parts.append((" / ".join(labels), at, size))
        end = max(end, at + size)
    by = {t["sig"]: data[t["offset"] : t["offset"] + t["size"]] for t in tags}
    xyz = lambda k: [s15(by[k][8 + 4 * i : 12 + 4 * i]) for i in range(3)] if k in by and len(by[k]) >= 20 else None
    head = {
        "total_size": struct.unpack(">I", data[:4])[0], "version": f"{data[8]}.{data[9] >> 4}", "profile_class": _ascii(data[12:16]), "color_space": _ascii(data[16:20]), "pcs": _ascii(data[20:24]),
        "description": icc_text(by.get("desc", b"")), "copyright": icc_text(by.get("cprt", b"")), "white_point": xyz("wtpt"), "black_point": xyz("bkpt"),
        "r_xyz": xyz("rXYZ"), "g_xyz": xyz("gXYZ"), "b_xyz": xyz("bXYZ"), **{f"{c}_trc": icc_curve(by.get(f"{c}TRC", b"")) for c in "rgb"},
    }
    return {"header": head, "tags": tags, "segments": [dict(zip(("label", "offset", "size"), p)) for p in parts]}


# ---------------------------------------------------------------- JPEG

# JPEG markers.
_MARKERS = {0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP", 0xFE: "COM"}
_SCAN_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.S)


def marker_name(code: int) -> str:
    if code in _MARKERS:
        return _MARKERS[code]
    if 0xC0 <= code <= 0xCF:
        return f"SOF{code - 0xC0}"
    if 0xD0 <= code <= 0xD7:
        return f"RST{code - 0xD0}"
    return f"APP{code - 0xE0}" if 0xE0 <= code <= 0xEF else f"0x{code:02X}"


def _jpeg_summary(name: str, b: bytes) -> str:
    if name.startswith("SOF") and len(b) >= 6:
        bits, high, wide, parts = struct.unpack(">BHHB", b[:6])
        return f"{wide}x{high}, {bits} bits, {parts} components"
    if name == "DQT":
        n, at = [], 0
        while at < len(b):
            n.append(str(b[at] & 15))
            at += 129 if b[at] >> 4 else 65
        return "tables " + ", ".join(n)
    if name == "DHT":
        n, at = [], 0
        while at + 17 <= len(b):
            n.append(f"{'AC' if b[at] >> 4 else 'DC'}{b[at] & 15}")
            at += 17 + sum(b[at + 1 : at + 17])
        return "tables " + ", ".join(n)
    if name == "SOS" and b:
        return f"{b[0]} components"
    if name.startswith("APP"):
        return b.split(b"\0", 1)[0][:20].decode("latin-1")
    if name == "DRI" and len(b) >= 2:
        return f"interval {struct.unpack('>H', b[:2])[0]}"
    return b[:60].decode("latin-1") if name == "COM" else ""


def jpeg(data: bytes) -> dict:
    """Segments in order, scan data apart, and the first frame of types 0 to 3."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, at, frame = [{"marker": "FFD8", "name": "SOI", "offset": 0, "size": 2, "summary": "", "is_scan": False}], 2, None
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        if data[at + 1] == 0xFF:
            at += 1
            continue
        code = data[at + 1]
        name = marker_name(code)
        size = 2
        if name not in ("SOI", "EOI") and not name.startswith("RST"):
            if at + 4 > len(data):
                break
            size = 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        b = data[at + 4 : at + size]
        out.append({"marker": f"FF{code:02X}", "name": name, "offset": at, "size": size, "summary": _jpeg_summary(name, b), "is_scan": False})
        if frame is None and 0xC0 <= code <= 0xC3 and len(b) >= 6:
            bits, high, wide, parts = struct.unpack(">BHHB", b[:6])
            frame = {"type": name, "precision": bits, "height": high, "width": wide, "components": parts}
        at += size
        if name == "EOI":
            break
        if name == "SOS":  # entropy-coded data: stuffed zeros and restart markers belong to it
            m = _SCAN_END.search(data, at)
            end = m.end() - 2 if m else len(data)
            out.append({"marker": "", "name": "scan", "offset": at, "size": end - at, "summary": "", "is_scan": True})
            at = end
    return {"segments": out, "frame": frame}


# ---------------------------------------------------------------- TrueType

# What the tables of a TrueType font hold.
TTF_TABLES = {
    "cmap": "Character to glyph mapping", "glyf": "Glyph outlines", "head": "Font header", "hhea": "Horizontal header", "hmtx": "Horizontal metrics",
    "loca": "Glyph locations", "maxp": "Maximum profile", "name": "Names", "post": "PostScript data", "OS/2": "OS/2 metrics", "cvt": "Control values",
    "fpgm": "Font program", "prep": "Control value program", "kern": "Kerning", "GSUB": "Glyph substitution", "GPOS": "Glyph positioning", "CFF": "CFF outlines",
}
_SFNT = (b"\0\1\0\0", b"true", b"OTTO")


def ttf_tables(data: bytes) -> list[dict]:
    if data[:4] not in _SFNT or len(data) < 12:
        raise ValueError("not an sfnt font")
    count = struct.unpack(">H", data[4:6])[0]
    out = []
    for i in range(min(count, (len(data) - 12) // 16)):
        tag, check, at, size = struct.unpack(">4sIII", data[12 + 16 * i : 28 + 16 * i])
        tag = _ascii(tag)
        out.append({"tag": tag, "checksum": f"{check:08X}", "offset": at, "length": size, "desc": TTF_TABLES.get(tag, "")})
    return sorted(out, key=lambda t: t["offset"])


def sfnt_checksum(block: bytes) -> int:
    b = block + b"\0" * (-len(block) % 4)
    return sum(struct.unpack(f">{len(b) // 4}I", b)) & 0xFFFFFFFF


def sfnt(tables: dict[str, bytes], flavour: bytes = b"\0\1\0\0") -> bytes:
    """A font file from its tables; each begins on four bytes."""
    n = len(tables)
    power = max(1, 1 << (n.bit_length() - 1))
    head = flavour + struct.pack(">HHHH", n, power * 16, power.bit_length() - 1, n * 16 - power * 16)
    at, rows, bodies = 12 + 16 * n, b"", b""
    for tag in sorted(tables):
        body = tables[tag]
        rows += struct.pack(">4sIII", tag.encode("latin-1").ljust(4), sfnt_checksum(body), at, len(body))
        body += b"\0" * (-len(body) % 4)
        bodies += body
        at += len(body)
    return head + rows + bodies


def ttf_complete(data: bytes) -> bytes:
    """The font with empty name, cmap and post tables where it lacks them, so that strict readers accept it."""
    tables = {t["tag"]: data[t["offset"] : t["offset"] + t["length"]] for t in ttf_tables(data)}
    tables.setdefault("name", struct.pack(">HHH", 0, 0, 6))
    tables.setdefault("cmap", struct.pack(">HH", 0, 0))
    tables.setdefault("post", struct.pack(">IiHHIIIII", 0x00030000, 0, 0, 0, 0, 0, 0, 0, 0))
    return sfnt(tables, data[:4])


def cmap_6_to_4(table: bytes) -> bytes:
    """A cmap subtable of format 6 as one of format 4 with a segment for each run of glyphs that count up."""
    kind, _, language, first, count = struct.unpack(">HHHHH", table[:10])
    if kind != 6:
        return table
    glyphs = struct.unpack(f">{count}H", table[10 : 10 + 2 * count])
    runs: list[list[int]] = []
    for i, g in enumerate(glyphs):
        if not g:
            continue
        code = first + i
        if runs and runs[-1][1] == code - 1 and runs[-1][2] == (g - code) & 0xFFFF:
            runs[-1][1] = code
        else:
            runs.append([code, code, (g - code) & 0xFFFF])
    runs.append([0xFFFF, 0xFFFF, 1])
    n = len(runs)
    power = 1 << (n.bit_length() - 1)
    column = lambda i: struct.pack(f">{n}H", *(r[i] for r in runs))
    body = struct.pack(">HHHH", 2 * n, 2 * power, power.bit_length() - 1, 2 * n - 2 * power) + column(1) + b"\0\0" + column(0) + column(2) + b"\0\0" * n
    return struct.pack(">HHH", 4, 6 + len(body), language) + body


# ---------------------------------------------------------------- character maps

_BLOCK = re.compile(rb"begin(bfchar|bfrange)(.*?)endbf(?:char|range)", re.S)
_HEX = rb"<\s*([0-9A-Fa-f\s]*)>"
_ITEM = {
    b"bfchar": re.compile(_HEX + rb"\s*" + _HEX),
    b"bfrange": re.compile(_HEX + rb"\s*" + _HEX + rb"\s*(?:" + _HEX + rb"|\[((?:\s*" + _HEX + rb")*)\s*\])"),
}


def _clean(h: bytes) -> str:
    return re.sub(rb"\s", b"", h).decode().upper()


@lru_cache(maxsize=1 << 12)
def _target(hexa: str) -> tuple[int | None, str]:
    raw = bytes.fromhex(hexa + "0" * (len(hexa) % 2))
    text = raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")
    return (ord(text[0]) if text else None), text


def _mappings(data: bytes) -> list[tuple[int, str, str]]:
    """``(code, source, target)`` of a ToUnicode map, the latter in hexadecimal, in code order (ties in file order)."""
    rows = []
    for block in _BLOCK.finditer(data):
        for m in _ITEM[block[1]].finditer(block[2]):
            low = _clean(m[1])
            if not low:
                continue
            if block[1] == b"bfchar":
                rows.append((int(low, 16), low, _clean(m[2])))
                continue
            a, b = int(low, 16), int(_clean(m[2]) or low, 16)
            if m[3] is not None:
                to = _clean(m[3])
                for code in range(a, min(b, a + 0xFFFF) + 1):
                    rows.append((code, f"{code:0{len(low)}X}", f"{int(to or '0', 16) + code - a:0{len(to)}X}"))
            else:
                for code, to in zip(range(a, b + 1), re.findall(_HEX, m[4])):
                    rows.append((code, f"{code:0{len(low)}X}", _clean(to)))
    rows.sort(key=lambda r: r[0])
    return rows


def cmap(data: bytes) -> dict:
    """Mappings of a ToUnicode map in code order (ties in file order), and what names it."""
    out = []
    for seq, (code, src, dst) in enumerate(_mappings(data)):
        point, char = _target(dst)
        out.append({"seq": seq, "src_int": code, "src_hex": src, "dst_hex": dst, "code_point": point, "char": char})
    found = lambda p: (m[1].decode("latin-1") if (m := re.search(p, data)) else None)
    return {"name": found(rb"/CMapName\s*/(\S+)"), "type": found(rb"/CMapType\s+(\d+)"), "registry": found(rb"/Registry\s*\(([^)]*)\)"),
            "ordering": found(rb"/Ordering\s*\(([^)]*)\)"), "rows": out}


def code_texts(data: bytes) -> dict:
    """The first character of each code of a ToUnicode map: by the code's number, and with its bytes counted in the bits above 32."""
    texts, wide = {}, {}
    for code, src, dst in _mappings(data):
        char = _target(dst)[1]
        texts.setdefault(code, char)
        wide.setdefault((len(src) // 2 << 32) + code, char)
    return {"texts": list(texts.items()), "wide_texts": list(wide.items())}


def cid_to_gid(data: bytes) -> list[tuple[int, int]]:
    n = len(data) // 2
    return [(cid, gid) for cid, gid in enumerate(struct.unpack(f">{n}H", data[: 2 * n])) if gid]


def cid_set(data: bytes) -> dict:
    """Bits from the most significant one: how many, the last, and the clear ones before it."""
    present = [8 * i + b for i, x in enumerate(data) for b in range(8) if x & (128 >> b)]
    return {"total_slots": 8 * len(data), "present_count": len(present), "last_cid": present[-1] if present else None, "coverage_hex": data.hex().upper(), "present": present}


# Glyph names of signs, and of accents put on a letter.
_SIGNS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’",
    "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]",
    "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "endash": "–", "emdash": "—",
    "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«",
    "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "trademark": "™", "copyright": "©", "registered": "®", "degree": "°", "section": "§",
    "paragraph": "¶", "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ",
    "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "florin": "ƒ", "fraction": "⁄", "perthousand": "‰", "sterling": "£", "yen": "¥", "cent": "¢", "currency": "¤", "Euro": "€",
    "exclamdown": "¡", "questiondown": "¿", "ordfeminine": "ª", "ordmasculine": "º", "mu": "µ", "multiply": "×", "divide": "÷", "plusminus": "±", "logicalnot": "¬",
    "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "periodcentered": "·", "brokenbar": "¦",
    "fi": "ﬁ", "fl": "ﬂ", "macron": "¯", "acute": "´", "dieresis": "¨", "cedilla": "¸", "circumflex": "ˆ", "tilde": "˜", "ring": "˚", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ogonek": "˛", "hungarumlaut": "˝",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "breve": "̆", "ogonek": "̨", "macron": "̄"}


def glyph_char(name: str) -> str:
    """Character of a glyph name: signs, letters, accented letters by composition, uniXXXX and uXXXX; else ``?``."""
    import unicodedata

    if name in _SIGNS:
        return _SIGNS[name]
    if len(name) == 1 and name.isalpha():
        return name
    if m := re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else "?"
    if name[:1].isalpha() and name[1:] in _ACCENTS:
        c = unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
        return c if len(c) == 1 else "?"
    return "?"


def encoding(name: str | None) -> dict[int, str]:
    """Characters of the codes 32 to 255."""
    codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(name or "", "latin-1")
    return {b: bytes([b]).decode(codec, "replace") for b in range(32, 256)}


def differences(items: list) -> dict[int, str]:
    """Codes of a /Differences array: a number sets the place, names follow it one by one."""
    out, at = {}, 0
    for x in items:
        if isinstance(x, int):
            at = x
        else:
            out[at] = x
            at += 1
    return out


# ---------------------------------------------------------------- hint tables


class Bits:
    """Big-endian bit fields."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("hint table ends early")
        a, z = self.at // 8, -(-(self.at + n) // 8)
        v = int.from_bytes(self.data[a:z], "big") >> (8 * z - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def row(self, n: int, counts: int) -> list[int]:
        out = [self.take(n) for _ in range(counts)]
        self.at = -(-self.at // 8) * 8  # a row ends on a byte
        return out


# Fields of the two table headers and their widths in bits.
PAGE_HEADER = (
    ("min_nobjects", 32), ("first_page_offset", 32), ("nbits_delta_nobjects", 16), ("min_page_length", 32), ("nbits_delta_page_length", 16), ("min_co_offset", 32),
    ("nbits_delta_co_offset", 16), ("min_co_length", 32), ("nbits_delta_co_length", 16), ("nbits_nshared", 16), ("nbits_shared_id", 16), ("nbits_shared_num", 16), ("shared_denom", 16),
)
SHARED_HEADER = (
    ("first_shared_obj", 32), ("first_shared_offset", 32), ("nshared_first_page", 32), ("nshared_total", 32), ("nbits_nobjects", 16), ("min_group_length", 32), ("nbits_delta_group_length", 16),
)


def hint_tables(data: bytes, n_pages: int, shared_at: int, first_page_obj: int = 0) -> dict:
    b = Bits(data)
    h = {k: b.take(w) for k, w in PAGE_HEADER}
    objects = b.row(h["nbits_delta_nobjects"], n_pages)
    lengths = b.row(h["nbits_delta_page_length"], n_pages)
    shared = b.row(h["nbits_nshared"], n_pages)
    ids = b.row(h["nbits_shared_id"], sum(shared)) if h["nbits_shared_id"] else []
    b.row(h["nbits_shared_num"], sum(shared))
    starts = b.row(h["nbits_delta_co_offset"], n_pages)
    sizes = b.row(h["nbits_delta_co_length"], n_pages)
    ends = list(accumulate(shared))
    pages = [
        {"page": i, "nobjects": h["min_nobjects"] + objects[i], "page_length": h["min_page_length"] + lengths[i], "content_offset": h["min_co_offset"] + starts[i],
         "content_length": h["min_co_length"] + sizes[i], "nshared": shared[i], "shared_ids": ids[ends[i] - shared[i] : ends[i]]}
        for i in range(n_pages)
    ]
    s = Bits(data, shared_at)
    g = {k: s.take(w) for k, w in SHARED_HEADER}
    n = g["nshared_total"]
    deltas = s.row(g["nbits_delta_group_length"], n)
    for signed in s.row(1, n):
        s.at += 128 * signed
    counts = [x + 1 for x in s.row(g["nbits_nobjects"], n)]
    # Groups of the first page count from its own object, the others from the first shared one.
    split = min(g["nshared_first_page"], n)
    firsts = [base + x for base, part in ((first_page_obj, counts[:split]), (g["first_shared_obj"], counts[split:])) for x in list(accumulate(part, initial=0))[:-1]]
    groups = [
        {"group": i, "group_length": g["min_group_length"] + deltas[i], "nobjects": counts[i], "first_obj": firsts[i], "section": "first_page" if i < split else "rest"}
        for i in range(n)
    ]
    return {"page_header": h, "pages": pages, "shared_header": g, "shared_groups": groups}


# ---------------------------------------------------------------- image parameters


def ccitt(k: int = 0, columns: int = 1728, rows: int | None = None, black_is_1: bool = False, align: bool = False, end_of_line: bool = False, end_of_block: bool = True) -> dict:
    short, long, standard = ("G4", "Group 4", "T.6") if k < 0 else ("G3-1D", "Group 3, one-dimensional", "T.4") if k == 0 else ("G3-2D", "Group 3, two-dimensional", "T.4")
    return {"k": k, "columns": columns, "rows": rows, "black_is_1": black_is_1, "encoded_byte_align": align, "end_of_line": end_of_line, "end_of_block": end_of_block,
            "compression_short": short, "compression_name": long, "standard": standard}


# Predictors of flate data.
PREDICTORS = {1: "None", 2: "TIFF 2", 10: "PNG None", 11: "PNG Sub", 12: "PNG Up", 13: "PNG Average", 14: "PNG Paeth", 15: "PNG optimum"}

# Flags of a font descriptor by bit number.
FONT_FLAGS = {1: "FixedPitch", 2: "Serif", 3: "Symbolic", 4: "Script", 6: "Nonsymbolic", 7: "Italic", 17: "AllCap", 18: "SmallCap", 19: "ForceBold"}
