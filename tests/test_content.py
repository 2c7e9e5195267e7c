from quire.functions import content as C


def brief(raw):
    return [(o["op"], o["category"], o["summary"]) for o in C.operators(raw)]


def test_catalogue_has_71_operators():
    assert len(C.CATEGORY) == 71
    raw = b" ".join(op.encode() if op not in ("ID", "EI") else b"" for op in C.CATEGORY) + b" zz"
    assert C.operators(raw)[-1]["category"] == "unknown"


def test_nested_operands_and_inline_images():
    assert brief(b"/P <</A <</B 1>> /C (>>)>> BDC [(a]b)-20(c)] TJ") == [("BDC", "marked", "/P"), ("TJ", "text_show", "a]bc")]
    assert [o["op"] for o in C.operators(b"BI /W 1 ID (((EI( \x00\nEI Q")] == ["BI", "ID", "EI", "Q"]
    assert brief(b"500 0 d0")[0][0] == "d0"


def test_summaries():
    assert brief(b"/F1 12 Tf 1 2 Td 1 0 0 1 5 6 cm 1 J 2 j 0.5 g 1 0 0 rg (x\\(y\\)) Tj") == [
        ("Tf", "text_state", "/F1  size 12"), ("Td", "text_pos", "dx=1  dy=2"), ("cm", "gstate", "[1, 0, 0, 1, 5, 6]"), ("J", "gstate", "1 round"), ("j", "gstate", "2 bevel"),
        ("g", "color", "gray=0.5"), ("rg", "color", "rgb(1, 0, 0)"), ("Tj", "text_show", "x(y)"),
    ]
    assert brief(b"(" + b"a" * 70 + b") Tj")[0][2] == "a" * 60 + "…"


def test_text_state_is_saved_and_restored():
    runs = C.text_runs(C.operators(b"BT /A 10 Tf 10 TL 1 0 0 1 100 700 Tm (a) Tj T* (b) Tj q /B 5 Tf (c) ' Q (d) Tj ET"))
    assert [(r["text"], r["font"], r["y"]) for r in runs] == [("a", "A", 700), ("b", "A", 690), ("c", "B", 680), ("d", "A", 680)]
    assert runs[3]["x"] == 100 + 0.5 * 5


def test_array_moves_and_codes():
    runs = C.text_runs(C.operators(b"BT /A 10 Tf [(a) -100 (b)] TJ <0041> Tj ET"), cmap={0x41: "Z"}, code_bytes=1)
    assert [r["text"] for r in runs] == ["ab", "\x00Z"] and runs[1]["x"] == 11


def test_checks():
    assert C.check_stream("BT (ET) Tj ET q Q") == []
    assert C.check_stream("BT q \x01") == ["control character", "BT/ET unbalanced", "q/Q unbalanced"]


def test_image_placement():
    assert C.image_placements(C.operators(b"q 10 0 0 -20 5 5 cm /Im1 Do Q /Im2 Do")) == [
        {"op_ix": 2, "name": "Im1", "width": 10, "height": -20, "flipped": True}, {"op_ix": 4, "name": "Im2", "width": 1, "height": 1, "flipped": False}]


def test_operations_are_operators_without_their_description():
    from quire.functions.content import operations, operators, text_runs

    raw = b"BT /F1 10 Tf 3 Tc 2 Tw 72 720 Td (a b) Tj [(c) -120 (d)] TJ <4142> ' ET"
    assert [{k: x[k] for k in ("op_ix", "op", "operands")} for x in operators(raw)] == operations(raw)
    fonts = {"F1": {"widths": {97: 333.3}, "default_width": 612.4, "cmap": {98: "BB", 1 << 32 | 99: "C", 100: ""}, "code_bytes": 1, "codes": None, "unknown": None}}
    runs = text_runs(operations(raw), fonts=fonts)
    assert [r["text"] for r in runs] == ["a BB", "Cd", "AB"]
    # A character's width, its spacing, and that of the word.
    assert abs(runs[1]["x"] - (72 + 6.333 + 11.124 + 9.124)) < 1e-9
