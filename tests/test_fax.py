"""CCITT images there and back."""

import random

import pytest

from quire.functions import fax


@pytest.mark.parametrize("black", [False, True])
def test_codes_are_told_apart(black):
    codes = [*fax.run_codes(black).values(), fax.END_OF_LINE]
    assert len(set(codes)) == 64 + 27 + 13 + 1
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def pictures(seed):
    rng = random.Random(seed)
    for columns in (1, 7, 8, 65, 300, 5300):
        width = -(-columns // 8)
        keep = (1 << width * 8) - (1 << (width * 8 - columns))
        rows = []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            x = rng.getrandbits(width * 8) if kind < 0.4 else 0 if kind < 0.55 else (1 << width * 8) - 1 if kind < 0.7 else int.from_bytes(rows[-1], "big") << 1 if rows else 0
            rows.append((x & keep).to_bytes(width, "big") if x & keep < 1 << width * 8 else bytes(width))
        yield columns, rows


@pytest.mark.parametrize("k", [-1, 0, 1, 4])
@pytest.mark.parametrize("lines", [False, True])
def test_round_trip(k, lines):
    for seed in range(12):
        for columns, rows in pictures(seed):
            data = fax.encode(rows, columns, k, lines)
            assert fax.decode(data, k, columns, 0, True) == b"".join(rows), (k, columns, seed)
            assert fax.decode(data, k, columns, len(rows), True) == b"".join(rows)


def test_known_rows():
    # White row of 8: vertical 0 alone; three black pixels in the middle: horizontal 2 white, 3 black, then vertical 0.
    assert fax.decode(bytes([0b11110000]), -1, 8, 4) == b"\xff" * 4
    assert fax.decode(int(("001" + "0111" + "10" + "1").ljust(16, "0"), 2).to_bytes(2, "big"), -1, 8, 1) == bytes([0b11000111])


def test_damage_and_missing_rows():
    rows = [bytes([255, 0]), bytes([0, 255]), bytes([15, 240])]
    data = fax.encode(rows, 16, 0, True)
    assert fax.decode(data[:5], 0, 16, 3, True)[:2] == rows[0] and len(fax.decode(data[:5], 0, 16, 3, True)) == 6
    assert fax.decode(b"", -1, 16, 2) == b"\xff" * 4 and fax.decode(b"\0\0\0", -1, 16, 1) == b"\xff\xff"
    for seed in range(200):
        raw = random.Random(seed).randbytes(40)
        for k in (-1, 0, 3):
            assert len(fax.decode(raw, k, 40, 9)) == 45


def test_rows_that_begin_on_a_byte():
    rows = [bytes([255, 0]), bytes([0, 255])]
    one = [fax._write_1d(fax.changes_of(r, 16), 16) for r in rows]
    data = b"".join(int(x.ljust(-(-len(x) // 8) * 8, "0"), 2).to_bytes(-(-len(x) // 8), "big") for x in one)
    assert fax.decode(data, 0, 16, 2, True, byte_align=True) == b"".join(rows)
