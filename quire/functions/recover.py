"""Objects of a damaged file, told by their own words instead of an index."""

from __future__ import annotations

import re

from .lexer import NULL, Reader, Value

_SPACE = rb"[\x00\t\n\x0c\r ]"
_HEAD = re.compile(rb"(?<![0-9A-Za-z.+-])(\d{1,10})" + _SPACE + rb"+(\d{1,5})" + _SPACE + rb"+obj(?![A-Za-z0-9])")
_AFTER_VALUE = re.compile(rb"(?:" + _SPACE + rb"|%[^\r\n]*[\r\n])*(?:endobj|xref|startxref|trailer|\d+" + _SPACE + rb"+\d+" + _SPACE + rb"+obj|$)")
_STREAM = re.compile(_SPACE + rb"*stream(?:\r\n|\n|\r)?")
_CLOSED = re.compile(_SPACE + rb"*endstream")
_END = re.compile(rb"(?:\r\n|\n|\r)?endstream")
_TRAILER = re.compile(rb"(?<![A-Za-z])trailer(?=" + _SPACE + rb"*<<)")

#: Bytes of values that may be read, as a multiple of the file's; beyond, a value ends at the next ``endobj`` or ``stream``.
REREAD = 8

Found = tuple[int, int, int, Value]


def body_end(data: bytes, start: int, declared: int | None) -> tuple[int, bool]:
    """End of a stream body, and whether the declared length is right: ``endstream`` has to follow it.

    Else the body ends before the next ``endstream``; of a stream that lacks one, with the file.
    """
    if declared is not None and declared >= 0 and _CLOSED.match(data, start + declared):
        return start + declared, True
    m = _END.search(data, start)
    return (m.start() if m else len(data)), False


class _Next:
    """Places of a word, asked for in ascending order: a far one is looked up once."""

    def __init__(self, data: bytes, word: bytes):
        self.data, self.word, self.at = data, word, -1

    def after(self, place: int) -> int:
        if self.at < place:
            found = self.data.find(self.word, place)
            self.at = found if found >= 0 else len(self.data)
        return self.at


def objects(data: bytes) -> list[Found]:
    """``(num, gen, offset, value)`` of everything that reads as an object, in file order.

    A header counts if a value follows it and, after that, an end, another
    header, the index, or the end of the file.  Stream bodies are stepped over,
    so that what looks like an object in them is none.
    """
    out, at, spent = [], 0, 0
    end_of_object, stream = _Next(data, b"endobj"), _Next(data, b"stream")
    while m := _HEAD.search(data, at):
        at = m.end()
        # Values may hold these words in strings; but where many are never closed, reading each to the end would take too long.
        free = spent <= REREAD * len(data)
        reader = Reader(data, at) if free else Reader(data[at : min(end_of_object.after(at), stream.after(at)) + 6])
        v = reader.value()
        behind = reader.at if free else at + reader.at
        spent += behind - at
        if v is None:
            continue
        s = _STREAM.match(data, behind) if v.kind == "Dictionary" else None
        if s:
            end, _ = body_end(data, s.end(), v.get("Length").int)
            v = Value("Stream", (v.data, data[s.end() : end], s.end()))
            behind = end
        elif not _AFTER_VALUE.match(data, behind):
            continue
        out.append((int(m[1]), int(m[2]), m.start(), v))
        at = behind
    return out


def trailer_of(data: bytes, found: list[Found]) -> tuple[Value, bool]:
    """All trailer dictionaries as one, later entries before earlier ones; and whether they name a root.

    Without a root the last catalog is it.
    """
    parts = [(m.start(), Reader(data, m.end()).value() or NULL) for m in _TRAILER.finditer(data)]
    parts += [(at, v) for _, _, at, v in found if v.get("Type").name == "XRef"]
    entries: dict[str, Value] = {}
    for _, v in sorted(parts, key=lambda p: p[0]):
        entries |= {k: x for k, x in v.entries.items() if k in ("Root", "Info", "ID", "Encrypt", "Size")}
    named = entries.get("Root", NULL).kind == "Reference"
    if not named:
        roots = [num for num, _, _, v in found if v.get("Type").name == "Catalog"]
        if roots:
            entries["Root"] = Value("Reference", (roots[-1], 0))
    return Value("Dictionary", entries), named


def entries_of(found: list[Found], members) -> dict[int, tuple]:
    """Index entries of the newest object of each number; ``members(value)`` lists the numbers in an object stream."""
    out: dict[int, tuple] = {}
    for num, gen, at, v in found:
        out[num] = (num, "in_use", at, gen, None, None)
        if v.get("Type").name == "ObjStm":
            out |= {inner: (inner, "compressed", None, 0, num, i) for i, inner in enumerate(members(v))}
    return out
