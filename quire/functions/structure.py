"""A whole PDF file to rows: cross-reference index, objects, flattened values, back-references."""

from __future__ import annotations

import hashlib
import re
from typing import Any

from . import recover
from .codecs import decode_chain, predict
from .lexer import NULL, Reader, Value

TAIL = 2048
TRAILER = -1

_ENTRY = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])")
_SUBSECTION = re.compile(rb"\s*(\d+)\s+(\d+)(?=\s)")
_HEADER = re.compile(rb"%PDF-(\d+\.\d+|[^\s]*)[^\r\n]*(?:\r\n|\n|\r)?(?:%([^\r\n]*))?")


class Damaged(ValueError):
    pass


def last_keyword(data: bytes, word: bytes, before: int | None = None, window: int = TAIL) -> int:
    """Place of the last ``word`` in the ``window`` bytes before a position; -1 if there is none."""
    end = len(data) if before is None else before
    return data.rfind(word, max(0, end - window), end)


def header(data: bytes) -> tuple[str, bytes | None]:
    """Version, and the binary marker if the comment below has four bytes or more, all of them high."""
    if not data.startswith(b"%PDF-"):
        raise Damaged("no %PDF- header")
    m = _HEADER.match(data)
    mark = m[2]
    return m[1].decode("latin-1"), mark if mark and len(mark) >= 4 and min(mark) >= 0x80 else None


def start_of_xref(data: bytes) -> int:
    at = last_keyword(data, b"startxref")
    m = re.compile(rb"startxref\s*(\d+)").match(data, at) if at >= 0 else None
    if not m:
        raise Damaged("no startxref")
    return int(m[1])


def filters_of(v: Value) -> list[str]:
    f = v.get("Filter")
    return [f.data] if f.kind == "Name" else [x.data for x in f.items if x.kind == "Name"]


def parameters(v: Value) -> Value:
    """Decode parameters; of an array, the last dictionary."""
    p = v.get("DecodeParms")
    return next((x for x in reversed(p.items) if x.kind == "Dictionary"), NULL) if p.kind == "Array" else p


def decoded(v: Value) -> bytes | None:
    """Body of a stream after its filters and predictor."""
    if v.kind != "Stream":
        return None
    p = parameters(v)
    body = decode_chain(v.data[1], filters_of(v))
    n = lambda key, other: p.get(key).int or other
    return predict(body, n("Predictor", 1), n("Columns", 1), n("Colors", 1), n("BitsPerComponent", 8))


def _table_section(data: bytes, at: int) -> tuple[list[tuple], Value]:
    entries = []
    while m := _SUBSECTION.match(data, at):
        first, count = int(m[1]), int(m[2])
        at = m.end()
        for i in range(count):
            e = _ENTRY.match(data, at)
            if not e:
                break
            at = e.end()
            kind = "in_use" if e[3] == b"n" else "free"
            entries.append((first + i, kind, int(e[1]), int(e[2]), None, None))
    t = data.find(b"trailer", at)
    trailer = Reader(data, t + 7).value() if t >= 0 else NULL
    return entries, trailer or NULL


def _stream_section(data: bytes, at: int) -> tuple[list[tuple], Value]:
    got = Reader(data, at).indirect()
    if not got or got[2].kind != "Stream":
        raise Damaged("no cross-reference section")
    v = got[2]
    body = decoded(v)
    if body is None:
        raise Damaged("cross-reference stream cannot be decoded")
    w = [x.int or 0 for x in v.get("W").items]
    index = [x.int or 0 for x in v.get("Index").items] or [0, v.get("Size").int or 0]
    entries, at = [], 0
    if len(w) < 3 or not sum(w):
        return entries, v
    for first, count in zip(index[::2], index[1::2]):
        for i in range(count):
            row = body[at : at + sum(w)]
            if len(row) < sum(w):
                break
            at += sum(w)
            a, b, c = (int.from_bytes(row[sum(w[:k]) : sum(w[: k + 1])], "big") for k in range(3))
            kind = a if w[0] else 1
            if kind == 0:
                entries.append((first + i, "free", b, c, None, None))
            elif kind == 1:
                entries.append((first + i, "in_use", b, c, None, None))
            elif kind == 2:
                entries.append((first + i, "compressed", None, 0, b, c))
    return entries, v


def sections(data: bytes, start: int) -> tuple[list[list[tuple]], Value, str]:
    """Cross-reference sections, newest first; the newest trailer; table or stream.

    ``/XRefStm`` of a hybrid file comes right after its section, then ``/Prev``.
    """
    out, trailer, kind, todo, seen = [], None, "", [start], set()
    while todo:  # no section is read twice
        at = todo.pop(0)
        if at in seen or at >= len(data):
            continue
        seen.add(at)
        skip = re.compile(rb"\s*").match(data, at).end()
        is_table = data.startswith(b"xref", skip)
        try:
            entries, t = _table_section(data, skip + 4) if is_table else _stream_section(data, skip)
        except Damaged:
            if trailer is None:
                raise
            continue
        out.append(entries)
        if trailer is None:
            trailer, kind = t, "table" if is_table else "stream"
        todo = [x for x in (t.get("XRefStm").int, t.get("Prev").int) if x is not None] + todo
    if trailer is None:
        raise Damaged("no cross-reference section")
    return out, trailer, kind


_OBJECT = re.compile(rb"\s*(\d+)\s+\d+\s+obj(?![A-Za-z0-9])")


class Document:
    """Index of one file, with objects read when asked for and kept.

    With ``repair`` an index that cannot be read is rebuilt from the objects
    themselves, entries that lead elsewhere are put right, and streams end where
    they say so; ``repairs`` lists ``(what, obj_num, offset)`` of each.
    """

    def __init__(self, data: bytes, repair: bool = False):
        self.data, self.repair, self.repairs = data, repair, []
        self._known: dict[int, Value | None] = {}
        self._hosts: dict[int, dict[int, Value]] = {}
        self._open: set[int] = set()
        try:
            self.version, self.marker = header(data)
            self.startxref: int | None = start_of_xref(data)
            parts, self.trailer, self.xref_type = sections(data, self.startxref)
        except Exception:
            if not repair or not (found := recover.objects(data)):
                raise
            parts = [self._rebuild(found)]
        self.rows, self.entries = [], {}
        for s, part in enumerate(parts):
            for i, e in enumerate(part):
                self.rows.append((s, i, *e))
                self.entries.setdefault(e[0], e)  # the newest section comes first and wins
        if repair and self.xref_type != "rebuilt":
            self._check_entries()
        offsets = [e[2] for e in self.entries.values() if e[1] == "in_use"]
        self.linearized = bool(offsets) and self.startxref is not None and max(offsets) > self.startxref

    def _rebuild(self, found: list) -> list[tuple]:
        """The one section of a file without a usable index."""
        at = self.data.find(b"%PDF-", 0, 1024)
        self.version, self.marker = header(self.data[at:]) if at >= 0 else (None, None)
        self.startxref, self.xref_type = None, "rebuilt"
        self.trailer, named = recover.trailer_of(self.data, found)
        self.repairs.append(("index", None, None))
        if not named:
            self.repairs.append(("trailer", None, None))
        return sorted(recover.entries_of(found, _member_numbers).values())

    def _check_entries(self) -> None:
        """Entries in use have to lead to an object of their number; where the file has it elsewhere, they do then."""
        wrong = [n for n, e in self.entries.items() if e[1] == "in_use" and not ((m := _OBJECT.match(self.data, e[2])) and int(m[1]) == n)]
        if not wrong:
            return
        true = recover.entries_of(recover.objects(self.data), _member_numbers)
        for n in wrong:
            if n in true:
                self.entries[n] = true[n]
                self.repairs.append(("entry", n, true[n][2]))

    def resolve(self, num: int) -> Value | None:
        """The object; generations play no part.  None if it is free, missing or unreadable."""
        if num in self._known:
            return self._known[num]
        e = self.entries.get(num)
        out = None
        if e and e[1] == "in_use":
            got = Reader(self.data, e[2]).indirect()
            out = self._with_length(got[2]) if got else None
            if self.repair and out is not None and out.kind == "Stream":
                out = self._with_end(num, out)
        elif e and e[1] == "compressed":
            out = self._members(e[4]).get(num)
        self._known[num] = out
        return out

    def _with_length(self, v: Value) -> Value:
        """A stream whose length is a reference has its body read again."""
        n = v.get("Length")
        if v.kind != "Stream" or v.data[1] or n.kind != "Reference" or n.data[0] in self._open:
            return v
        self._open.add(n.data[0])
        size = self.resolve(n.data[0])
        self._open.discard(n.data[0])
        if size is None or not size.int or size.int < 0:
            return v
        at = v.data[2]
        return Value("Stream", (v.data[0], self.data[at : at + size.int], at))

    def _with_end(self, num: int, v: Value) -> Value:
        """A stream whose length is missing or wrong ends at its ``endstream``."""
        n = v.get("Length")
        declared = len(v.data[1]) if n.kind == "Reference" else n.int
        end, sound = recover.body_end(self.data, v.data[2], declared)
        if sound:
            return v
        self.repairs.append(("length", num, v.data[2]))
        return Value("Stream", (v.data[0], self.data[v.data[2] : end], v.data[2]))

    def _members(self, host: int) -> dict[int, Value]:
        """All objects of an object stream, decoded once; a host inside itself holds nothing."""
        if host in self._hosts:
            return self._hosts[host]
        if host in self._open:
            return {}
        self._open.add(host)
        v = self.resolve(host)
        self._open.discard(host)
        body = decoded(v) if v is not None else None
        out: dict[int, Value] = {}
        if body is not None:
            first = v.get("First").int or 0
            for num, at in _member_places(v, body):
                out[num] = Reader(body, first + at).value() or NULL
        self._hosts[host] = out
        return out


def _member_places(v: Value, body: bytes) -> list[tuple[int, int]]:
    """Numbers and places of the objects in an object stream."""
    pairs = [int(x) for x in re.findall(rb"\d+", body[: v.get("First").int or 0])][: 2 * (v.get("N").int or 0)]
    return list(zip(pairs[::2], pairs[1::2]))


def _member_numbers(v: Value) -> list[int]:
    body = decoded(v)
    return [num for num, _ in _member_places(v, body)] if body is not None else []


# ---------------------------------------------------------------- rows


#: Keys of the first items of an array.
_KEYS = [f"[{i}]" for i in range(1024)]


def children(v: Value) -> list[tuple[str, Value]]:
    if v.kind == "Array":
        items = v.data
        return list(zip(_KEYS if len(items) <= len(_KEYS) else [f"[{i}]" for i in range(len(items))], items))
    return list(v.entries.items())


def nodes(num: int, gen: int, v: Value) -> list[dict]:
    """The value tree of an object in document order; node 0 is the object itself."""
    out, todo = [], [(v, None, None, "", 0, 0)]
    while todo:
        cur, parent, key, path, depth, order = todo.pop()
        ix, (kind, d) = len(out), cur
        whole = true = number = text = ref_num = ref_gen = None
        below = ()
        if kind == "Integer":
            whole = d if -(1 << 63) <= d < 1 << 63 else None
        elif kind in ("Name", "LiteralString", "HexString"):
            text = d
        elif kind == "Reference":
            ref_num, ref_gen = d
        elif kind == "Real":
            number = d
        elif kind == "Boolean":
            true = d
        else:
            below = children(cur)
        out.append({"obj_num": num, "gen": gen, "node_ix": ix, "parent_ix": parent, "depth": depth, "key": key, "key_path": path, "ord": order, "kind": kind, "n_children": len(below),
                    "bool_v": true, "int_v": whole, "real_v": number, "str_v": text, "ref_num": ref_num, "ref_gen": ref_gen})
        if below:
            start, deeper = f"{path}." if depth else "", depth + 1
            todo += [(x, ix, k, start + k, deeper, i) for i, (k, x) in zip(range(len(below) - 1, -1, -1), reversed(below))]
    return out


#: Values that references can be in.
_HOLDERS = frozenset(("Reference", "Array", "Dictionary", "Stream"))


def references(num: int, gen: int, v: Value) -> list[dict]:
    """References within an object in the order of the reverse index: later siblings first, depth first."""
    kind = v.get("Type").name or v.kind
    out, todo = [], [(x, k) for k, x in children(v) if x.kind in _HOLDERS]
    while todo:
        cur, path = todo.pop()
        if cur.kind == "Reference":
            out.append({"obj_num": cur.data[0], "from_num": num, "from_gen": gen, "key_path": path, "type_name": kind})
        else:
            todo += [(x, f"{path}.{k}") for k, x in children(cur) if x.kind in _HOLDERS]
    return out


def parse_file(data: bytes) -> dict:
    """One file as nested rows; damage becomes the ``error`` of an otherwise empty row."""
    out: dict[str, Any] = {
        "file_id": hashlib.sha256(data).hexdigest(), "length": len(data), "version": None, "binary_marker": None, "startxref": None,
        "xref_type": None, "linearized": None, "error": None, "xref": [], "objects": [], "nodes": [], "backrefs": [], "repairs": [],
    }
    try:
        doc = Document(data, repair=True)
    except Exception as e:  # whatever is wrong with a file stays a row of that file
        out["error"] = f"{type(e).__name__}: {e}"
        return out
    out |= {"version": doc.version, "binary_marker": doc.marker, "startxref": doc.startxref, "xref_type": doc.xref_type, "linearized": doc.linearized}
    if doc.trailer.get("Encrypt").kind != "Null":
        out["error"] = "encrypted"
    names = ("section_ix", "entry_ix", "obj_num", "etype", "offset", "gen", "stm_num", "stm_index")
    out["xref"] = [dict(zip(names, r)) for r in doc.rows]
    refs: list[dict] = []
    for num, e in doc.entries.items():
        if e[1] == "free":
            continue
        error = None
        try:
            v = doc.resolve(num)
        except Exception as x:
            v, error = None, f"{type(x).__name__}: {x}"
        gen = e[3] or 0
        row = {"obj_num": num, "gen": gen, "kind": None, "type_name": None, "subtype": None, "filters": None, "stream_offset": None,
               "stream_raw": None, "stream_decoded": None, "error": error}
        if v is not None:
            row |= {"kind": v.kind, "type_name": v.get("Type").name, "subtype": v.get("Subtype").name}
            if v.kind == "Stream":
                row |= {"filters": filters_of(v), "stream_offset": v.data[2], "stream_raw": v.data[1], "stream_decoded": decoded(v)}
            out["nodes"] += nodes(num, gen, v)
            refs += references(num, gen, v)
        elif not error:
            row["error"] = "unresolved"
        out["objects"].append(row)
    out["nodes"] += nodes(TRAILER, 0, Value("Dictionary", doc.trailer.entries))
    refs += [
        {"obj_num": x.data[0], "from_num": TRAILER, "from_gen": 0, "key_path": k, "type_name": "Trailer"}
        for k, x in doc.trailer.entries.items() if x.kind == "Reference"
    ]
    out["backrefs"] = [r | {"ord": i} for i, r in enumerate(refs)]
    out["repairs"] = [{"what": w, "obj_num": n, "offset": at} for w, n, at in doc.repairs]
    return out
