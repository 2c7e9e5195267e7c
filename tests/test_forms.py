"""Nested forms."""

from quire.functions import write as W
from quire.operators import forms
from quire.operators.corpus import Corpus
from tests.test_operators import files, rows


def doubling(depth):
    """Form ``i`` draws form ``i + 1`` twice; the last one a line."""
    ref, d = W.ref, W.dictionary
    kind = {"Type": "XObject", "Subtype": "Form"}
    out = [(1, d(Type="Catalog", Pages=ref(2))), (2, d(Type="Pages", Kids=[ref(3)], Count=1, Resources=d(XObject=d(F=ref(10))))), (3, d(Type="Page", Parent=ref(2), Contents=ref(4))), (4, W.stream(b"/F Do /F Do /None Do"))]
    out += [(10 + i, W.stream(b"/F Do q 1 0 0 1 3 0 cm /F Do Q", Resources=d(XObject=d(F=ref(11 + i))), **kind)) for i in range(depth)]
    out.append((10 + depth, W.stream(b"0 0 m 1 1 l S BT (x) Tj ET", Resources=d(XObject=d(F=ref(10))), **kind)))
    return W.assemble(out, {"Root": ref(1)})


def test_counts_do_not_unfold(spark):
    c = Corpus.from_binary(files(spark, doubling(8)))
    c = Corpus(c.parsed.cache())
    placed = forms.placements(c, count_only=True)
    assert placed.count() == 9 and placed.agg({"n": "max"}).first()[0] == 2**9
    assert rows(forms.path_counts(c), "obj_num", "n_lines", "n_strokes") == {(3, 2**9, 2**9)}


def test_positions_and_order(spark):
    c = Corpus.from_binary(files(spark, doubling(2)))
    c = Corpus(c.parsed.cache())
    got = forms.text_runs(c, with_fonts=False).orderBy("at").collect()
    assert [r.x for r in got] == [0, 3, 3, 6] * 2 and {r.holder for r in got} == {12} and {r.obj_num for r in got} == {3}


def test_no_forms(spark):
    c = Corpus.from_binary(files(spark, W.layout("lay1", "a\nb", "en", "s")))
    c = Corpus(c.parsed.cache())
    assert forms.placements(c).count() == 0 and forms.placements(c, count_only=True).count() == 0
    assert [r.text for r in forms.text_runs(c).orderBy("at").collect()] == ["a", "b"] and forms.path_counts(c).count() == 0
