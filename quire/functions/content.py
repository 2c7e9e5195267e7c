"""Content streams: operators with their operands, summaries, checks, and the text state machine."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from .codes import is_utf16
from .lexer import SKIP, hex_bytes, literal

# The 71 operators of the PDF specification by category, and the order of the categories.
CATEGORIES = {
    "text_state": "BT ET Tf Tc Tw Tz TL Tr Ts",
    "text_pos": "Td TD Tm T*",
    "text_show": "Tj TJ ' \"",
    "gstate": "q Q cm gs w J j M d ri i",
    "color": "cs CS sc SC scn SCN g G rg RG k K",
    "path": "m l c v y h re S s f F f* B B* b b* n",
    "clip": "W W*",
    "xobject": "Do",
    "shading": "sh",
    "marked": "BMC BDC EMC MP DP",
    "inline_img": "BI ID EI",
    "compat": "BX EX",
    "unknown": "",
}
CATEGORY = {op: c for c, ops in CATEGORIES.items() for op in ops.split()}
# What names a content stream when three of its first words are among these.
PROBE_OPS = "BT ET Tf Tm Td TD Tj TJ q Q cm gs rg RG cs CS scn SCN re m l h S f Do w".split()

# What each operator does, and the label and colour of each category.
DESCRIPTIONS = {
    "BT": "Begin text object", "ET": "End text object", "Tf": "Select font and size", "Tc": "Set character spacing", "Tw": "Set word spacing", "Tz": "Set horizontal scaling",
    "TL": "Set text leading", "Tr": "Set text rendering mode", "Ts": "Set text rise", "Td": "Move text position", "TD": "Move text position and set leading",
    "Tm": "Set text matrix and line matrix", "T*": "Move to start of next line", "Tj": "Show text string", "TJ": "Show text with individual glyph offsets",
    "'": "Move to next line and show text", '"': "Set word/char spacing, move to next line, show text", "q": "Save graphics state", "Q": "Restore graphics state",
    "cm": "Concatenate matrix to CTM", "gs": "Set parameters from graphics state resource", "w": "Set line width", "J": "Set line cap style", "j": "Set line join style",
    "M": "Set miter limit", "d": "Set line dash pattern", "ri": "Set color rendering intent", "i": "Set flatness tolerance", "cs": "Set non-stroking color space",
    "CS": "Set stroking color space", "sc": "Set non-stroking color", "SC": "Set stroking color", "scn": "Set non-stroking color (extended)", "SCN": "Set stroking color (extended)",
    "g": "Set gray level (non-stroking)", "G": "Set gray level (stroking)", "rg": "Set RGB color (non-stroking)", "RG": "Set RGB color (stroking)", "k": "Set CMYK color (non-stroking)",
    "K": "Set CMYK color (stroking)", "m": "Begin new subpath (move to)", "l": "Append straight line segment", "c": "Append cubic Bézier curve (full)",
    "v": "Append cubic Bézier (first cp = current point)", "y": "Append cubic Bézier (last cp = final point)", "h": "Close current subpath", "re": "Append rectangle",
    "S": "Stroke path", "s": "Close and stroke path", "f": "Fill path (nonzero winding rule)", "F": "Fill path (nonzero winding rule, obsolete)", "f*": "Fill path (even-odd rule)",
    "B": "Fill and stroke (nonzero winding rule)", "B*": "Fill and stroke (even-odd rule)", "b": "Close, fill and stroke (nonzero)", "b*": "Close, fill and stroke (even-odd)",
    "n": "End path without painting", "W": "Set clipping path (nonzero winding rule)", "W*": "Set clipping path (even-odd rule)", "Do": "Invoke named XObject", "sh": "Paint shading pattern",
    "BMC": "Begin marked-content sequence", "BDC": "Begin marked-content sequence with property list", "EMC": "End marked-content sequence", "MP": "Define marked-content point",
    "DP": "Define marked-content point with property list", "BI": "Begin inline image object", "ID": "Begin inline image data", "EI": "End inline image object",
    "BX": "Begin compatibility section", "EX": "End compatibility section",
}
LABELS = {
    "text_state": "Text state", "text_pos": "Text positioning", "text_show": "Text show", "gstate": "Graphics state", "color": "Color", "path": "Path", "clip": "Clipping",
    "xobject": "XObject", "shading": "Shading", "marked": "Marked content", "inline_img": "Inline image", "compat": "Compatibility", "unknown": "Unknown",
}
COLORS = {c: {"inline_img": "inline"}.get(c, c.replace("_", "-")) for c in LABELS}

_REGULAR = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?!" + _REGULAR + rb")|[+-]?\d*\.?\d+")
_WORD = re.compile(rb"[A-Za-z'\"*0-9]+|" + _REGULAR + rb"+")
_NAME = re.compile(rb"/" + _REGULAR + rb"*")
#: End of inline image data: EI between white space, where what follows reads as content.
_EI = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")

Operand = tuple[str, str]


def _text(b: bytes) -> str:
    return b.decode("latin-1")


def _composite(data: bytes, at: int) -> int:
    """End of the array or dictionary that begins at ``at``; brackets within strings do not count."""
    depth = 0
    while at < len(data):
        two = data[at : at + 2]
        c = two[:1]
        if c == b"(":
            _, at = literal(data, at + 1)
            continue
        if two in (b"<<", b">>"):
            depth += 1 if two == b"<<" else -1
            at += 2
        elif c == b"<":
            at = (data.find(b">", at) + 1) or len(data)
        else:
            depth += (c == b"[") - (c == b"]")
            at += 1
        if depth <= 0:
            return at
    return at


def tokens(data: bytes):
    """(kind, text) with kinds op, num, name, string, array, dict_val."""
    at = 0
    while True:
        at = SKIP.match(data, at).end()
        if at >= len(data):
            return
        c = data[at : at + 1]
        start = at
        if c == b"(":
            _, at = literal(data, at + 1)
            yield "string", _text(data[start:at])
        elif data[at : at + 2] == b"<<" or c == b"[":
            at = _composite(data, at)
            yield ("array" if c == b"[" else "dict_val"), _text(data[start:at])
        elif c == b"<":
            at = (data.find(b">", at) + 1) or len(data)
            yield "string", _text(data[start:at])
        elif c == b"/":
            at = _NAME.match(data, at).end()
            yield "name", _text(data[start:at])
        elif (m := _NUMBER.match(data, at)) and not data[at : m.end()].endswith((b"+", b"-")):
            at = m.end()
            yield "num", _text(m[0])
        elif m := _WORD.match(data, at):
            at = m.end()
            yield "op", _text(m[0])
            if m[0] == b"ID":  # image data are not content
                e = _EI.search(data, at)
                at = e.start() + 1 if e else len(data)
        else:
            at += 1


def printable(s: str) -> str:
    return re.sub(r"[^ -~]", "·", s)


def shown(raw: str) -> str:
    """A literal string operand as text."""
    if not (raw.startswith("(") and raw.endswith(")")):
        return raw
    s = re.sub(r"\\[nrt]", " ", raw[1:-1])
    return printable(s.replace("\\(", "(").replace("\\)", ")").replace("\\\\", "\\"))


def _cut(s: str) -> str:
    return s[:60] + "…" if len(s) > 60 else s


# The styles of line ends and joins.
_STYLES = {"J": ["butt", "round", "projecting square"], "j": ["miter", "round", "bevel"]}
_FORMS = {
    "Tf": (2, "{0}  size {1}"), "Td": (2, "dx={0}  dy={1}"), "TD": (2, "dx={0}  dy={1}"),
    "Tm": (6, "[{0}, {1}, {2}, {3}, {4}, {5}]"), "cm": (6, "[{0}, {1}, {2}, {3}, {4}, {5}]"),
    "rg": (3, "rgb({0}, {1}, {2})"), "RG": (3, "rgb({0}, {1}, {2})"), "k": (4, "cmyk({0}, {1}, {2}, {3})"), "K": (4, "cmyk({0}, {1}, {2}, {3})"),
    "g": (1, "gray={0}"), "G": (1, "gray={0}"), "re": (4, "x={0}  y={1}  w={2}  h={3}"),
}
_FIRST = set("Do gs cs CS ri w Tc Tw Tz TL Tr Ts i M BMC BDC MP DP".split())


def summary(op: str, operands: list[Operand]) -> str:
    vals = [v for _, v in operands]
    if not vals:
        return ""
    if op in ("Tj", "'") or op == '"' and len(vals) >= 3:
        return _cut(shown(vals[-1]))
    if op == "TJ":
        return _cut("".join(shown(_text(b"(" + s + b")")) for s in show_strings(vals[0].encode("latin-1"))))
    if op in _FORMS and len(vals) >= _FORMS[op][0]:
        return _FORMS[op][1].format(*vals)
    if op in _STYLES:
        styles = _STYLES[op]
        return f"{int(vals[0])} {styles[int(vals[0])]}" if vals[0].isdigit() and int(vals[0]) < len(styles) else vals[0]
    if op in _FIRST:
        return vals[0]
    return "  ".join(vals[: 4 if op in ("sc", "SC", "scn", "SCN") else 3])


def show_strings(array: bytes) -> list[bytes]:
    """Literal strings of a TJ array, with their escapes."""
    out, at = [], 0
    while (at := array.find(b"(", at)) >= 0:
        _, end = literal(array, at + 1)
        out.append(array[at + 1 : end - 1])
        at = end
    return out


def operators(data: bytes) -> list[dict]:
    """Operators in order with category, summary and operands; none at all for data without operators."""
    out, held = [], []
    for kind, text in tokens(data):
        if kind != "op":
            held.append((kind, text))
            continue
        out.append({"op_ix": len(out), "op": text, "category": CATEGORY.get(text, "unknown"), "summary": summary(text, held),
                    "operands": [{"type": k, "value": v} for k, v in held]})
        held = []
    return out


def operations(data: bytes) -> list[dict]:
    """``operators`` without category and summary, for machines that only carry them out."""
    out, held = [], []
    for kind, text in tokens(data):
        if kind != "op":
            held.append({"type": kind, "value": text})
            continue
        out.append({"op_ix": len(out), "op": text, "operands": held})
        held = []
    return out


def check_stream(text: str) -> list[str]:
    """What is wrong with an edited stream: control characters, unbalanced text objects and saved states."""
    out = []
    if "\0" in text:
        out.append("NUL byte")
    if re.search(r"[\x01-\x08\x0b\x0e-\x1f]", text):
        out.append("control character")
    words = re.findall(r"(?<![^\s])(?:BT|ET|q|Q)(?![^\s])", re.sub(r"\((?:\\.|[^\\)])*\)", "", text))
    for a, b in (("BT", "ET"), ("q", "Q")):
        if words.count(a) != words.count(b):
            out.append(f"{a}/{b} unbalanced")
    return out


# ---------------------------------------------------------------- text positions

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(m: tuple, n: tuple) -> tuple:
    """Apply ``m`` first, then ``n``."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


def _string_bytes(raw: str) -> bytes:
    b = raw.encode("latin-1")
    return hex_bytes(b[1:-1]) if b.startswith(b"<") else literal(b, 1)[0]


def _array_items(raw: str) -> list:
    inner = raw.encode("latin-1")[1:-1]
    return [float(t) if k == "num" else _string_bytes(t) for k, t in tokens(inner) if k in ("num", "string")]


def _codes(raw: bytes, font: dict) -> list[tuple[int, int]]:
    """``(n, code)`` of a string: by the font's code spaces, else of its one width."""
    if font.get("codes"):
        return font["codes"].split(raw)
    step = font["code_bytes"]
    return [(len(p), int.from_bytes(p, "big")) for i in range(0, len(raw), step) for p in (raw[i : i + step],)]


class _Known(dict):
    """What a function gives for a key, asked once."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        self[key] = found = self.find(key)
        return found


def text_runs(ops: list[dict], widths: dict[int, float] | None = None, default_width: float = 500.0, cmap: dict[int, str] | None = None, code_bytes: int = 1, fonts: dict[str, dict] | None = None) -> list[dict]:
    """Position and state of every shown string.

    Saved states hold the text state too; widths are in thousandths of the font
    size.  Unknown codes read as Latin-1.  ``fonts`` gives ``widths, default_width,
    cmap, code_bytes`` by resource name, and ``codes`` (code spaces) where a font
    has a map of its own; the other arguments serve names it lacks.  Strings in a
    font with an ``unknown`` predefined map have no text and no advance, but a
    ``note``; where its codes are UTF-16 they are read as that.
    """
    plain = {"widths": widths or {}, "default_width": default_width, "cmap": cmap or {}, "code_bytes": code_bytes}
    state = {"ctm": IDENTITY, "font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0, "Tr": 0}
    saved: list[dict] = []
    tm = line = IDENTITY
    out = []

    def char(texts, n, code):
        return texts.get(n << 32 | code) or texts.get(code) or (chr(code) if code < 256 else "�")

    def step(font, size, Tc, Tw, Tz, n, code, cid):
        return (font["widths"].get(cid, font["default_width"]) / 1000 * size + Tc + (Tw if code == 32 and n == 1 else 0)) * Tz / 100

    # Of fonts with codes of a byte: characters, and advances in a state.
    chars = _Known(lambda name: _Known(lambda code: char((fonts or {}).get(name, plain)["cmap"], 1, code)))
    steps = _Known(lambda key: _Known(lambda code: step((fonts or {}).get(key[0], plain), *key[1:], 1, code, code)))

    def num(o, i, other=0.0):
        try:
            return float(o[i]["value"])
        except (IndexError, ValueError):
            return other

    def move(x, y):
        nonlocal tm, line
        tm = line = multiply((1, 0, 0, 1, x, y), line)

    def show(ix, parts):
        nonlocal tm
        at = multiply(tm, state["ctm"])
        text, advance, note = [], 0.0, None
        font = (fonts or {}).get(state["font"], plain)
        texts, unknown = font["cmap"], font.get("unknown")
        now = (state["size"], state["Tc"], state["Tw"], state["Tz"])
        if unknown:
            note = f"codes of {unknown} are not known"
        by_byte = font["code_bytes"] == 1 and not unknown and not font.get("codes")
        for p in parts:
            if isinstance(p, float):
                advance -= p / 1000 * state["size"] * state["Tz"] / 100
                continue
            if by_byte:
                text.append("".join(map(chars[state["font"]].__getitem__, p)))
                advance = reduce(add, map(steps[state["font"], *now].__getitem__, p), advance)
                continue
            if unknown and not is_utf16(unknown):
                continue
            for n, code in _codes(p, font):
                if unknown:
                    text.append(code.to_bytes(n, "big").decode("utf-16-be", "replace"))
                else:
                    text.append(char(texts, n, code))
                advance += step(font, *now, n, code, font["codes"].cid(n, code) if font.get("codes") else code)
        shown_text = None if unknown and not is_utf16(unknown) else "".join(text)
        out.append({"op_ix": ix, "x": at[4], "y": at[5] + state["Ts"], "font": state["font"], "size": state["size"], "render_mode": state["Tr"], "text": shown_text, "note": note})
        tm = multiply((1, 0, 0, 1, advance, 0), tm)

    for x in ops:
        op, o = x["op"], x["operands"]
        if op == "q":
            saved.append(dict(state))
        elif op == "Q" and saved:
            state = saved.pop()
        elif op == "cm" and len(o) >= 6:
            state["ctm"] = multiply(tuple(num(o, i) for i in range(6)), state["ctm"])
        elif op == "BT":
            tm = line = IDENTITY
        elif op == "Tf" and len(o) >= 2:
            state["font"], state["size"] = o[0]["value"].lstrip("/"), num(o, 1)
        elif op in ("Tc", "Tw", "Tz", "TL", "Ts"):
            state[op] = num(o, 0)
        elif op == "Tr":
            state["Tr"] = int(num(o, 0))
        elif op in ("Td", "TD"):
            if op == "TD":
                state["TL"] = -num(o, 1)
            move(num(o, 0), num(o, 1))
        elif op == "Tm" and len(o) >= 6:
            tm = line = tuple(num(o, i) for i in range(6))
        elif op == "T*":
            move(0, -state["TL"])
        elif op == "Tj" and o:
            show(x["op_ix"], [_string_bytes(o[-1]["value"])])
        elif op == "TJ" and o:
            show(x["op_ix"], _array_items(o[-1]["value"]))
        elif op in ("'", '"') and o:
            if op == '"' and len(o) >= 3:
                state["Tw"], state["Tc"] = num(o, 0), num(o, 1)
            move(0, -state["TL"])
            show(x["op_ix"], [_string_bytes(o[-1]["value"])])
    return out


def draw_calls(ops: list[dict]) -> list[dict]:
    """Each ``Do`` with its name and the whole matrix in force, from the stream's own coordinates."""
    out, ctm, saved = [], IDENTITY, []
    for x in ops:
        o = x["operands"]
        if x["op"] == "q":
            saved.append(ctm)
        elif x["op"] == "Q" and saved:
            ctm = saved.pop()
        elif x["op"] == "cm" and len(o) >= 6:
            try:
                ctm = multiply(tuple(float(v["value"]) for v in o[:6]), ctm)
            except ValueError:
                continue
        elif x["op"] == "Do" and o:
            out.append({"op_ix": x["op_ix"], "name": o[0]["value"].lstrip("/"), "matrix": list(ctm)})
    return out


def image_placements(ops: list[dict]) -> list[dict]:
    """Each ``Do`` with the matrix in force; a negative fourth number turns the image upside down."""
    out, ctm, saved = [], IDENTITY, []
    for x in ops:
        o = x["operands"]
        if x["op"] == "q":
            saved.append(ctm)
        elif x["op"] == "Q" and saved:
            ctm = saved.pop()
        elif x["op"] == "cm" and len(o) >= 6:
            try:
                ctm = multiply(tuple(float(v["value"]) for v in o[:6]), ctm)
            except ValueError:
                continue
        elif x["op"] == "Do" and o:
            out.append({"op_ix": x["op_ix"], "name": o[0]["value"].lstrip("/"), "width": ctm[0], "height": ctm[3], "flipped": ctm[3] < 0})
    return out
