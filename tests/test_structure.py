"""Files written by hand, byte by byte, apart from our own writer where it matters."""

import pytest

from quire.functions import structure as S
from quire.functions import write as W
from quire.functions.lexer import Value


def file(objects: list[bytes], eol: bytes = b"\n", trailer: bytes = b"/Root 1 0 R") -> bytes:
    out, at = b"%PDF-1.7" + eol + b"%\xe2\xe3\xcf\xd3" + eol, []
    for o in objects:
        at.append(len(out))
        out += o + eol
    start = len(out)
    out += b"xref" + eol + b"0 %d" % (len(objects) + 1) + eol + b"0000000000 65535 f\r\n" + b"".join(b"%010d 00000 n\r\n" % a for a in at)
    return out + b"trailer" + eol + b"<</Size %d %s>>" % (len(objects) + 1, trailer) + eol + b"startxref" + eol + b"%d" % start + eol + b"%%EOF"


BASE = [b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj", b"3 0 obj <</Type /Page /Parent 2 0 R>> endobj"]


@pytest.mark.parametrize("eol", [b"\n", b"\r\n"])
def test_classic_file(eol):
    r = S.parse_file(file(BASE, eol))
    assert (r["error"], r["version"], r["xref_type"], len(r["xref"]), r["binary_marker"]) == (None, "1.7", "table", 4, b"\xe2\xe3\xcf\xd3")
    assert [o["type_name"] for o in r["objects"]] == ["Catalog", "Pages", "Page"]


def test_incremental_update_newest_wins():
    old = file(BASE)
    prev = old.rindex(b"xref\n0 ")
    at = len(old) + 1
    new = old + b"\n3 0 obj <</Type /Page /New true>> endobj\n"
    start = len(new)
    new += b"xref\n3 1\n%010d 00000 n\r\ntrailer\n<</Size 4 /Root 1 0 R /Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, prev, start)
    doc = S.Document(new)
    assert doc.resolve(3).get("New") == Value("Boolean", True)
    assert [r[0] for r in doc.rows] == [0, 1, 1, 1, 1]
    # A section that names itself as predecessor ends the walk.
    assert S.Document(new.replace(b"/Prev %d" % prev, b"/Prev %d" % start)).entries.keys() == {3}


@pytest.mark.parametrize("predictor", [0, 12])
def test_xref_stream_with_and_without_predictor(predictor):
    members = [(5, W.dictionary(A=1)), (6, W.wrap([1, 2])), (7, W.wrap(9))]
    data = W.assemble_packed([(1, W.dictionary(Type="Catalog"))], members, {"Root": W.ref(1)}, predictor)
    doc = S.Document(data)
    assert doc.resolve(5).get("A").int == 1
    assert [x.int for x in doc.resolve(6).items] == [1, 2]
    assert doc.resolve(7).int == 9


def test_indirect_and_missing_length():
    r = file([*BASE, b"4 0 obj <</Length 5 0 R>> stream\nabcde\nendstream endobj", b"5 0 obj 5 endobj", b"6 0 obj <</X 1>> stream\nabc\nendstream endobj"])
    doc = S.Document(r)
    assert doc.resolve(4).data[1] == b"abcde"
    assert doc.resolve(6).data[1] == b""


def test_object_stream_that_holds_itself():
    data = W.assemble_packed([(1, W.dictionary(Type="Catalog"))], [(2, W.wrap(3))], {"Root": W.ref(1)})
    doc = S.Document(data)
    doc.entries[3] = (3, "compressed", None, 0, 3, 0)
    doc._known.clear(), doc._hosts.clear()
    assert doc.resolve(2) is None


@pytest.mark.parametrize("raw", [b"", b"not a pdf", b"%PDF-1.4\nno index", b"%PDF-1.4\nstartxref\n999999\n%%EOF", b"%PDF-1.4\nstartxref\n0\n%%EOF"])
def test_damage_is_an_error_row(raw):
    r = S.parse_file(raw)
    assert r["error"] and r["objects"] == []


def test_encrypted_is_told():
    assert S.parse_file(file(BASE, trailer=b"/Root 1 0 R /Encrypt <<>>"))["error"] == "encrypted"


def test_reference_order_is_last_sibling_first():
    refs = S.references(9, 0, W.dictionary(A=W.ref(1), B=[W.ref(2), W.ref(3)], C=W.dictionary(D=W.ref(4))))
    assert [(r["obj_num"], r["key_path"]) for r in refs] == [(4, "C.D"), (3, "B.[1]"), (2, "B.[0]"), (1, "A")]


def test_nodes_keep_document_order():
    n = S.nodes(1, 0, W.dictionary(A=[1, 2], B=True))
    assert [(x["key_path"], x["kind"], x["parent_ix"]) for x in n] == [("", "Dictionary", None), ("A", "Array", 0), ("A.[0]", "Integer", 1), ("A.[1]", "Integer", 1), ("B", "Boolean", 0)]


def test_a_hundred_sections_are_all_read():
    data = W.layout("lay1", "text", "en", "s")
    for i in range(100):
        data = W.updated(data, 10 + i, W.dictionary(Title=Value("LiteralString", str(i))), 10 + i + 1)
    r = S.parse_file(data)
    assert r["error"] is None and len({e["section_ix"] for e in r["xref"]}) == 101
    assert {o["obj_num"] for o in r["objects"]} >= {1, 2, 3, 4, 5, 6, *range(10, 110)}
