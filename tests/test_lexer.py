"""Byte literals with rows written by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions.lexer import NULL, Reader, Value, parse
from quire.functions.write import body


def plain(v):
    if v.kind == "Array":
        return [plain(x) for x in v.data]
    if v.kind == "Dictionary":
        return {k: plain(x) for k, x in v.data.items()}
    return v.data


@pytest.mark.parametrize(
    ("raw", "kind", "data"),
    [
        (b"/A#20B", "Name", "A B"), (b"/A#zz", "Name", "A#zz"), (b"(a(b)c)", "LiteralString", "a(b)c"), (b"(\\101\\n\\\nx\\q)", "LiteralString", "A\nxq"),
        (b"<48 65 6>", "HexString", "He`"), (b"+1", "Integer", 1), (b"-.5", "Real", -0.5), (b"4.", "Real", 4.0), (b"-", "Integer", 0), (b".", "Real", 0.0),
        (b"1 0 R", "Reference", (1, 0)), (b"1 0 Rx", "Integer", 1), (b"true", "Boolean", True), (b"null", "Null", None), (b"foo", "Null", None), (b"\xb2", "Null", None),
        (b"%c\n 7", "Integer", 7), (b"(open", "LiteralString", "open"),
    ],
)
def test_scalars(raw, kind, data):
    assert parse(raw) == Value(kind, data)


def test_containers():
    assert plain(parse(b"<</K 1 /K 2 (x) 5 /L [1 [2 /N]] >>")) == {"K": 2, "L": [1, [2, "N"]]}
    assert plain(parse(b"[1 2")) == [1, 2]
    assert parse(b"]") == NULL


def test_deep_nesting_is_cut():
    assert parse(b"[" * 5000).kind == "Array"


def test_stream_needs_a_direct_length():
    num, gen, v = Reader(b"4 0 obj <</Length 3>> stream\r\nabc\nendstream endobj").indirect()
    assert (num, gen, v.kind, v.data[1]) == (4, 0, "Stream", b"abc")
    assert Reader(b"4 0 obj <</Length 5 0 R>> stream\nabc endstream").indirect()[2].data[1] == b""


values = st.recursive(
    st.none().map(lambda _: NULL) | st.booleans().map(lambda b: Value("Boolean", b)) | st.integers(-(2**60), 2**60).map(lambda i: Value("Integer", i))
    | st.text(st.characters(max_codepoint=255), max_size=12).map(lambda s: Value("LiteralString", s))
    | st.text(st.characters(max_codepoint=255), max_size=12).map(lambda s: Value("HexString", s))
    | st.text(st.characters(min_codepoint=1, max_codepoint=255), min_size=1, max_size=8).map(lambda s: Value("Name", s))
    | st.tuples(st.integers(0, 999), st.integers(0, 9)).map(lambda r: Value("Reference", r)),
    lambda inner: st.lists(inner, max_size=4).map(lambda x: Value("Array", x))
    | st.dictionaries(st.text(st.characters(min_codepoint=33, max_codepoint=126), min_size=1, max_size=5), inner, max_size=4).map(lambda d: Value("Dictionary", d)),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(values)
def test_parse_inverts_write(v):
    assert parse(body(v)) == v
