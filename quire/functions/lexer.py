"""PDF values from bytes: one regular expression for the tokens, a short recursive reader for the values."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

KINDS = ("Null", "Boolean", "Integer", "Real", "LiteralString", "HexString", "Name", "Array", "Dictionary", "Stream", "Reference")
#: Deeper nesting is cut: what lies below reads as null, so that hostile files cannot exhaust the stack.
MAX_DEPTH = 200


class Value(NamedTuple):
    """``data``: the scalar; a list; a dict; for a reference ``(num, gen)``; for a stream ``(dict, body, body offset)``."""

    kind: str
    data: Any = None

    def get(self, key: str) -> Value:
        d = self.entries
        return d.get(key, NULL)

    @property
    def entries(self) -> dict:
        if self.kind == "Dictionary":
            return self.data
        return self.data[0] if self.kind == "Stream" else {}

    @property
    def name(self) -> str | None:
        return self.data if self.kind == "Name" else None

    @property
    def int(self) -> int | None:
        return self.data if self.kind == "Integer" else None

    @property
    def number(self) -> float | None:
        return self.data if self.kind in ("Integer", "Real") else None

    @property
    def items(self) -> list:
        return self.data if self.kind == "Array" else []


NULL = Value("Null")

_SPACE = rb"\x00\t\n\x0c\r "
_DELIM = rb"()<>\[\]{}/%"
SKIP = re.compile(rb"(?:[" + _SPACE + rb"]+|%[^\r\n]*)*")
#: A token behind any white space and comments.
_TOKEN = re.compile(
    rb"(?:[" + _SPACE + rb"]++|%[^\r\n]*+)*+(?:(?P<open><<)|(?P<close>>>)|(?P<array>\[)|(?P<end>\])|(?P<text>\()|<(?P<hex>[^>]*)(?:>|$)"
    rb"|/(?P<name>[^" + _SPACE + _DELIM + rb"]*)|(?P<number>[+-]?[0-9.][0-9.+-]*|[+-])|(?P<word>[^" + _SPACE + _DELIM + rb"]+)|(?P<odd>.))",
    re.S,
)
#: What is left of an array that has nothing but whole numbers.
_WHOLE_NUMBERS = re.compile(rb"[\t\n\r ]*+((?:[0-9]++[\t\n\r ]++)*+(?:[0-9]++)?)\]")
_INDIRECT = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj(?![A-Za-z0-9])")
_REF = re.compile(rb"[" + _SPACE + rb"]+(\d+)[" + _SPACE + rb"]+R(?![^" + _SPACE + _DELIM + rb"])")
_NAME_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_TEXT_STOP = re.compile(rb"[()\\]")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _latin(b: bytes) -> str:
    return b.decode("latin-1")


def name_text(raw: bytes) -> str:
    """``#hh`` escapes resolved; other number signs stay as they are."""
    return _latin(_NAME_ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw)


def hex_bytes(raw: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    return bytes.fromhex(_latin(digits + b"0" * (len(digits) % 2)))


def number(raw: bytes) -> Value:
    """A full stop makes it real; a lone sign or full stop is zero; what follows a second one is dropped."""
    if raw.isdigit():
        return Value("Integer", int(raw))
    text = _latin(raw)
    m = re.match(r"[+-]?\d*(\.\d*)?", text)
    body = m[0]
    if "." in body:
        return Value("Real", float(body) if re.search(r"\d", body) else 0.0)
    return Value("Integer", int(body) if re.search(r"\d", body) else 0)


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening bracket lies before ``at``; its bytes and the place behind it."""
    out, depth = [], 1
    while True:
        m = _TEXT_STOP.search(data, at)
        if not m:
            out.append(data[at:])
            return b"".join(out), len(data)
        out.append(data[at : m.start()])
        at = m.end()
        if m[0] == b"(":
            depth += 1
            out.append(b"(")
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return b"".join(out), at
            out.append(b")")
        elif o := _OCTAL.match(data, at):
            out.append(bytes([int(o[0], 8) & 255]))
            at = o.end()
        else:
            c = data[at : at + 1]
            at += 1
            if c == b"\r":
                at += data[at : at + 1] == b"\n"
            elif c != b"\n":
                out.append(_ESCAPES.get(c, c))


class Reader:
    """Reads values from ``data``, keeping its place in ``at``."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = SKIP.match(self.data, self.at).end()

    def token(self) -> tuple[str, bytes, int] | None:
        """(kind, text, start) of the next token; strings only by their bracket."""
        m = _TOKEN.match(self.data, self.at)
        if not m:
            self.skip()
            return None
        self.at = m.end()
        kind = m.lastgroup
        return kind, m[kind], m.start(kind) - (kind in ("hex", "name"))

    def peek_word(self, word: bytes) -> bool:
        """Step over ``word`` if it comes next."""
        at = self.at
        t = self.token()
        if t and t[0] == "word" and t[1] == word:
            return True
        self.at = at
        return False

    def value(self, depth: int = 0) -> Value | None:
        """The next value; null for an unknown word; None at a closing bracket or the end."""
        t = self.token()
        if not t:
            return None
        kind, raw, _ = t
        if kind == "number":
            v = number(raw)
            if v.kind == "Integer" and v.data >= 0 and (m := _REF.match(self.data, self.at)):
                self.at = m.end()
                return Value("Reference", (v.data, int(m[1])))
            return v
        if kind == "name":
            return Value("Name", name_text(raw))
        if kind == "text":
            body, self.at = literal(self.data, self.at)
            return Value("LiteralString", _latin(body))
        if kind == "hex":
            return Value("HexString", _latin(hex_bytes(raw)))
        if kind == "word":
            return {b"true": Value("Boolean", True), b"false": Value("Boolean", False)}.get(raw, NULL)
        if depth >= MAX_DEPTH:
            return NULL
        if kind == "array":
            if m := _WHOLE_NUMBERS.match(self.data, self.at):
                self.at = m.end()
                return Value("Array", [Value("Integer", int(x)) for x in m[1].split()])
            out = []
            while True:
                at = self.at
                v = self.value(depth + 1)
                if v is not None:
                    out.append(v)
                    continue
                self.at = at
                t = self.token()
                if t is None or t[0] == "end":
                    return Value("Array", out)
        if kind == "open":
            return Value("Dictionary", self._dictionary(depth))
        return None if kind in ("close", "end") else NULL

    def _dictionary(self, depth: int) -> dict:
        """Keys other than names are skipped; of repeated keys the last counts."""
        out: dict[str, Value] = {}
        while True:
            t = self.token()
            if t is None or t[0] == "close":
                return out
            if t[0] == "text":
                _, self.at = literal(self.data, self.at)
            if t[0] != "name":
                continue
            at = self.at
            v = self.value(depth + 1)
            if v is None:
                self.at = at
                v = NULL
            out[name_text(t[1])] = v

    def indirect(self) -> tuple[int, int, Value] | None:
        """``N G obj value`` at the present place."""
        m = _INDIRECT.match(self.data, self.at)
        if not m:
            return None
        self.at = m.end()
        v = self.value()
        if v is None:
            v = NULL
        if v.kind == "Dictionary":
            at = self.at
            if self.peek_word(b"stream"):
                v = self._stream(v)
            else:
                self.at = at
        return int(m[1]), int(m[2]), v

    def _stream(self, d: Value) -> Value:
        if self.data[self.at : self.at + 2] == b"\r\n":
            self.at += 2
        elif self.data[self.at : self.at + 1] in (b"\n", b"\r"):
            self.at += 1
        n = d.get("Length").int
        body = self.data[self.at : self.at + n] if n and n > 0 else b""
        start = self.at
        self.at += len(body)
        return Value("Stream", (d.data, body, start))


def parse(data: bytes) -> Value:
    return Reader(data).value() or NULL
