"""JPEG pixels."""

import struct

import numpy as np
import pytest

from quire.functions import jpeg as J


def picture(width, height, channels, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    base = 128 + 100 * np.sin(x / 9 + seed)[..., None] * np.cos(y[..., None] / 7 + np.arange(channels)) + rng.normal(0, 12, (height, width, channels))
    return np.clip(base, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (13, 9), (64, 40)])
@pytest.mark.parametrize("restart", [0, 3])
def test_grey_within_one(size, restart):
    p = picture(*size, 1)
    w, h, n, out = J.decode(J.encode(p.tobytes(), *size, 1, restart=restart))
    assert (w, h, n) == (*size, 1) and np.abs(np.frombuffer(out, np.uint8).astype(int) - p.ravel()).max() <= 1


BLOCK = "67207468652074686520746865207468652074686520746865207468652074686520746865207468652074686520746865207468652074686520746865207468"


def test_rounding_errors_that_add_up():
    """A block whose coefficients, each rounded to the nearest, give a sample that is off by two."""
    raw = bytes.fromhex(BLOCK)
    c, x = J.cosines(), np.frombuffer(raw, np.uint8).reshape(8, 8).astype(int)
    nearest = np.rint(c.T @ np.rint(c @ (x - 128.0) @ c.T) @ c + 128)
    assert np.abs(nearest - x).max() == 2
    out = np.frombuffer(J.decode(J.encode(raw, 8, 8))[3], np.uint8).reshape(8, 8).astype(int)
    assert np.abs(out - x).max() <= 1


def test_colours():
    p = picture(50, 30, 3)
    w, h, n, out = J.decode(J.encode(p.tobytes(), 50, 30, 3))
    assert n == 3 and np.abs(np.frombuffer(out, np.uint8).astype(int) - p.ravel()).max() <= 3


def test_zigzag_and_transform():
    assert J.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and J.zigzag()[-3:].tolist() == [55, 62, 63] and sorted(J.zigzag()) == list(range(64))
    assert np.allclose(J.cosines() @ J.cosines().T, np.eye(8))


def test_sampled_chrominance():
    """A grey picture of three components, the second and third at half the size, interleaved as 4:2:0."""
    first, rest = ({s: f"{code:0{n}b}" for code, n, s in J._codes(*t)} for t in (J._DC, J._AC))
    text, last = "", 0
    values = [80, -40, 16, 0, 8, 24]  # DC of six luminance units
    for unit in range(1):
        for v in values[:4]:
            n, d = J._write_number(v - last)
            last = v
            text += first[n] + d + rest[0]
        text += (first[0] + rest[0]) * 2
    scan = int(text.ljust(-(-len(text) // 8) * 8, "1"), 2).to_bytes(-(-len(text) // 8), "big").replace(b"\xff", b"\xff\0")
    seg = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    data = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([1] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += seg(0xC4, b"\0" + J._DC[0] + J._DC[1] + b"\x10" + J._AC[0] + J._AC[1]) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    w, h, n, out = J.decode(data)
    p = np.frombuffer(out, np.uint8).reshape(16, 16, 3)
    assert [p[y, x].tolist() for y, x in ((0, 0), (0, 15), (15, 0), (15, 15))] == [[138] * 3, [123] * 3, [130] * 3, [128] * 3]


def test_unreadable():
    good = J.encode(picture(16, 16, 1).tobytes(), 16, 16)
    for bad in (b"", b"\xff\xd8\xff\xd9", good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:300]):
        with pytest.raises(J.Unreadable):
            J.decode(bad)


def test_a_number_of_more_bits_than_there_are():
    """A table of codes may name up to 255 bits for a number; none has more than 16."""
    good = J.encode(picture(8, 8, 1).tobytes(), 8, 8)
    with pytest.raises(J.Unreadable):
        J.decode(good.replace(bytes(range(12)), bytes(range(100, 112))))
