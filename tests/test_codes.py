"""Codes of mixed width."""

import random

from quire.functions import write as W
from quire.functions.codes import Codes, read_code_map
from quire.functions.content import operators, text_runs
from quire.operators import formats, text
from quire.operators.corpus import Corpus
from tests.test_operators import files, rows

SHIFT_JIS = [(1, 0x00, 0x80), (2, 0x8140, 0x9FFC), (1, 0xA0, 0xDF), (2, 0xE040, 0xFCFC)]


def test_code_spaces_agree_with_a_real_encoding():
    text_ = "aB1 あいう漢字ｱｲ終"
    raw = text_.encode("shift_jis")
    assert b"".join(code.to_bytes(n, "big") for n, code in Codes(SHIFT_JIS).split(raw)).decode("shift_jis") == text_
    assert [n for n, _ in Codes(SHIFT_JIS).split(raw)] == [len(x.encode("shift_jis")) for x in text_]


def test_bytes_outside_all_spaces():
    c = Codes(SHIFT_JIS)
    assert c.split(b"\xff\x41") == [(1, 0xFF), (1, 0x41)]
    assert c.split(b"\x81\x20\x41") == [(2, 0x8120), (1, 0x41)]  # the first byte fits two-byte spaces only
    assert c.split(b"\x81") == [(1, 0x81)] and c.split(b"") == []
    assert Codes().split(b"\0A\0B\0") == [(2, 0x41), (2, 0x42), (1, 0)]


def test_splitting_loses_no_byte():
    rng = random.Random(5)
    for _ in range(300):
        spaces = []
        for _ in range(rng.randint(1, 5)):
            n = rng.randint(1, 4)
            ends = [sorted((rng.randrange(256), rng.randrange(256))) for _ in range(n)]
            spaces.append((n, int.from_bytes(bytes(e[0] for e in ends), "big"), int.from_bytes(bytes(e[1] for e in ends), "big")))
        raw = rng.randbytes(rng.randint(0, 40))
        assert b"".join(code.to_bytes(n, "big") for n, code in Codes(spaces).split(raw)) == raw


def test_character_ids():
    m = read_code_map(b"1 begincodespacerange <00> <80> endcodespacerange 2 begincidrange <20> <30> 5 <25> <26> 90 endcidrange 1 begincidchar <41> 77 endcidchar /Other-H usecmap")
    assert m["uses"] == "Other-H" and m["spaces"] == [{"n": 1, "low": 0, "high": 0x80}]
    c = Codes([(1, 0, 0x80)], [(x["n"], x["low"], x["high"], x["cid"]) for x in m["cids"]])
    assert [c.cid(1, x) for x in (0x20, 0x25, 0x30, 0x41, 0x42)] == [5, 10, 21, 77, 0] and c.cid(2, 0x20) == 0
    assert Codes().cid(2, 0x1234) == 0x1234


def test_predefined_maps_are_told():
    fonts = {"F": {"widths": {}, "default_width": 1000.0, "cmap": {}, "code_bytes": 2, "unknown": "GBK-EUC-H"}}
    got = text_runs(operators(b"BT /F 1 Tf (ab) Tj (cd) Tj ET"), fonts=fonts)
    assert [(r["text"], r["x"], r["note"]) for r in got] == [(None, 0.0, "codes of GBK-EUC-H are not known")] * 2


def test_chains_of_maps(spark):
    ref, d = W.ref, W.dictionary
    use = lambda n, text_: W.stream(text_, Type="CMap", UseCMap=n)
    font = lambda n: d(Type="Font", Subtype="Type0", BaseFont="X", Encoding=ref(n), DescendantFonts=[])
    one = lambda a: b"1 begincidchar <%02X> %d endcidchar" % (a, a)
    objects = [(1, d(Type="Catalog")), (2, font(10)), (3, font(20)), (4, font(30)),
               (10, use(ref(11), one(1))), (11, use(ref(12), one(2))), (12, use(ref(10), one(3))),  # a loop
               (20, use(W.wrap("Identity-H"), one(4))), (30, use(ref(31), one(5))), (31, use(W.wrap("KSC-EUC-H"), one(6)))]
    c = Corpus.from_binary(files(spark, W.assemble(objects, {"Root": ref(1)})))
    c = Corpus(c.parsed.cache())
    got = {r.obj_num: ([x.cid for x in r.code_map.cids], r.unknown_map) for r in formats.code_maps(c).collect()}
    assert got[10] == ([1, 2, 3], None) and got[20] == ([4, 0], None) and got[30] == ([5, 6], "KSC-EUC-H")
    assert rows(formats.code_maps(Corpus(c.parsed.limit(0))), "obj_num") == set()
    assert text.text_runs(text.content_bytes(c), formats.page_fonts(c)).count() == 0
