"""Linking from rows against linking each file in one piece."""

import json

import pytest

from quire.functions import structure as S
from quire.functions import write as W
from quire.operators import pdfx, relink
from tests.test_operators import files

TEXT = "one\ntwo\nthree\nfour\nfive\nsix"


@pytest.mark.parametrize("layout", ["lay1", "lay2p", "book", "lay4"])
@pytest.mark.parametrize("small", [False, True])
def test_same_as_in_one_piece(spark, monkeypatch, layout, small):
    if small:
        monkeypatch.setattr(relink, "SEGMENT", 64)
        monkeypatch.setattr(relink, "ENTRIES", 3)
    data = W.layout(layout, TEXT, "en", "s")
    exploded = pdfx.explode_files(files(spark, data, data, data)).select("path", "name", "data").collect()
    new = json.dumps({"_obj": "6 0", "value": {"Title": "edited", "Author": "x" * 500}}).encode()
    # The first file stays, the second has another information dictionary, the third other contents too.
    edits = {("1.pdf", "objects/00006_0.pdfjson"): new, ("2.pdf", "objects/00006_0.pdfjson"): new}
    stream = next((r.name for r in exploded if r.path == "2.pdf" and r.name.endswith(".pdfs")), None)
    if stream:
        edits["2.pdf", stream] = b"BT ET"
    rows = [(r.path, r.name, bytearray(edits.get((r.path, r.name), bytes(r.data)))) for r in exploded]
    frame = spark.createDataFrame(rows, "path string, name string, data binary").cache()
    got = {r.path: bytes(r.content) for r in relink.link(pdfx.manifest(files(spark, data, data, data)), frame).collect()}
    want = {r.path: bytes(r.content) for r in pdfx.link(frame).collect()}
    assert got["0.pdf"] == data == want["0.pdf"]
    for path in ("1.pdf", "2.pdf"):
        a, b = S.parse_file(got[path]), S.parse_file(want[path])
        assert a["error"] is None and a["repairs"] == [] and a["xref_type"] == b["xref_type"]
        if a["xref_type"] == "table":
            assert got[path] == want[path]
        # Index streams have no filter here, which their own entries say; all else is the same.
        own = {o["obj_num"] for o in a["objects"] if o["type_name"] == "XRef"}
        plain = lambda r: [{k: v for k, v in o.items() if k != "stream_offset"} for o in sorted(r["objects"], key=lambda o: o["obj_num"]) if o["obj_num"] not in own]
        assert plain(a) == plain(b) and [n for n in a["nodes"] if n["obj_num"] == 6] == [n for n in b["nodes"] if n["obj_num"] == 6]
