"""Files with a broken index, wrong lengths, cut tails."""

import pytest

from quire.functions import recover as R
from quire.functions import structure as S
from quire.functions import write as W
from tests.test_structure import BASE, file


def parsed(data):
    r = S.parse_file(data)
    return r["error"], {o["obj_num"]: o for o in r["objects"]}, {(x["what"], x["obj_num"]) for x in r["repairs"]}


WHOLE = file([*BASE, b"4 0 obj <</Length 9>> stream\n7 0 obj 1\nendstream endobj", b"5 0 obj (a 8 0 obj 1 endobj) endobj"])


def test_sound_file_needs_nothing():
    assert parsed(WHOLE)[2] == set()


@pytest.mark.parametrize("damage", [lambda d: d.replace(b"startxref", b"startxxxx"), lambda d: d[: d.rindex(b"xref\n0")], lambda d: b"junk" + d, lambda d: d[d.index(b"1 0 obj"):], lambda d: d.rsplit(b"startxref", 1)[0] + b"startxref\n5\n%%EOF"])
def test_index_from_objects(damage):
    error, objects, repairs = parsed(damage(WHOLE))
    assert error is None and sorted(objects) == [1, 2, 3, 4, 5] and ("index", None) in repairs
    # What reads as an object in a stream or a string is none.
    assert objects[4]["stream_raw"] == b"7 0 obj 1" and objects[1]["type_name"] == "Catalog"


def test_newest_object_wins_and_cut_object_counts():
    data = b"%PDF-1.4\n1 0 obj <</Type /Catalog>> endobj 2 0 obj 1 endobj\n2 0 obj 2 endobj\n3 0 obj <</Length 100>> stream\nabc"
    doc = S.Document(data, repair=True)
    assert doc.resolve(2).int == 2 and doc.resolve(3).data[1] == b"abc" and doc.trailer.get("Root").data == (1, 0)
    assert {("index", None, None), ("trailer", None, None)} <= set(doc.repairs)


def test_object_streams_of_a_lost_index():
    members = [(5, W.dictionary(A=1)), (6, W.wrap([1, 2]))]
    data = W.assemble_packed([(1, W.dictionary(Type="Catalog"))], members, {"Root": W.ref(1)})
    doc = S.Document(data[: data.rindex(b"startxref")], repair=True)
    assert doc.resolve(5).get("A").int == 1 and [x.int for x in doc.resolve(6).items] == [1, 2] and doc.trailer.get("Root").data == (1, 0)


def test_wrong_missing_and_indirect_lengths():
    for length in (b"/Length 1", b"/Length 9999", b"/X 1", b"/Length 9 0 R", b"/Length -4"):
        _, objects, repairs = parsed(file([*BASE, b"4 0 obj <<" + length + b">> stream\r\nabc\r\nendstream endobj"]))
        assert objects[4]["stream_raw"] == b"abc" and repairs == {("length", 4)}, length
    _, objects, repairs = parsed(file([*BASE, b"4 0 obj <</Length 0>> stream\nendstream endobj"]))
    assert objects[4]["stream_raw"] == b"" and not repairs


def test_entry_that_leads_elsewhere():
    data = file(BASE)
    at = data.index(b"2 0 obj")
    _, objects, repairs = parsed(data.replace(b"%010d 00000 n" % at, b"%010d 00000 n" % 3))
    assert repairs == {("entry", 2)} and objects[2]["type_name"] == "Pages"


def test_nothing_to_find():
    assert parsed(b"")[0] and parsed(b"no such thing")[0] and R.objects(b"1 0 obj") == []
    # Many headers without a value cost one look each.
    assert R.objects(b"1 0 obj ] " * 20000) == [] and len(R.objects(b"1 0 obj [ (" * 20000)) == 1
