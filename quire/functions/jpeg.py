"""Sequential JPEG pictures to pixels, and pixels to such pictures."""

from __future__ import annotations

import struct
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np


class Part(NamedTuple):
    """A component of a frame: its number, sampling factors, and quantisation table."""

    ident: int
    across: int
    down: int
    table: int


class Unreadable(ValueError):
    pass


@cache
def zigzag() -> np.ndarray:
    """Places in a block, row by row, of coefficients in the order of the file: along diagonals, in turn up and down."""
    cells = sorted(((x + y, x if (x + y) % 2 == 0 else y, y * 8 + x) for x in range(8) for y in range(8)))
    return np.array([c[2] for c in cells])


@cache
def cosines() -> np.ndarray:
    """The orthonormal transform of eight samples."""
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """``(code, length, symbol)`` of a table: codes count up and double with each length."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((code, length, s))
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=16)
def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For every 16 bits the symbol and length of the code that they begin with."""
    out = [(0, 0)] * 65536
    for code, length, s in _codes(counts, symbols):
        first, n = code << (16 - length), 1 << (16 - length)
        if first + n > 65536:
            raise Unreadable("bad code table")
        out[first : first + n] = [(s, length)] * n
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.at, self.size = 0, 8 * len(data)
        # The 64 bits that begin with each byte, zeros beyond the end.
        self.words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(24), np.uint8), 8).copy().view(">u8").ravel().tolist()

    def block(self, first: list[tuple[int, int]], rest: list[tuple[int, int]]) -> list[int]:
        """64 numbers in the order of the file, the first of them less its predecessor.

        A code gives the zeros before a number and its bits; a number that begins with 0 is negative.
        """
        words, at, size = self.words, self.at, self.size
        out, k, table = [0] * 64, 0, first
        while k < 64:
            if at > size + 16:  # as far as a code can look ahead
                raise Unreadable("scan ends early")
            s, length = table[(words[at >> 3] >> (48 - (at & 7))) & 0xFFFF]
            if not length:
                raise Unreadable("bad code")
            at += length
            n = s
            if k:
                n = s & 15
                if not n:
                    if s != 0xF0:
                        break
                    k += 16
                    continue
                k += s >> 4
                if k > 63:
                    raise Unreadable("too many coefficients")
            if n:
                if n > 16 or at + n > size + 32:
                    raise Unreadable("bad code" if n > 16 else "scan ends early")
                v = (words[at >> 3] >> (64 - (at & 7) - n)) & ((1 << n) - 1)
                at += n
                out[k] = v if v >> (n - 1) else v - (1 << n) + 1
            k += 1
            table = rest
        self.at = at
        return out


def _segments(data: bytes):
    """``(marker, body, place behind it)`` up to the end of the picture."""
    if data[:2] != b"\xff\xd8":
        raise Unreadable("not a JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0x00, 0xFF, 0x01) or 0xD0 <= data[at + 1] <= 0xD8:
            at += 1
            continue
        if data[at + 1] == 0xD9:
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield data[at + 1], data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


def _scan_parts(data: bytes, at: int) -> list[bytes]:
    """Entropy-coded bytes from ``at``, cut at restart markers, without stuffed zeros."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[start:])
            break
        code = data[at + 1]
        if code == 0:
            at += 2
        elif 0xD0 <= code <= 0xD7:
            out.append(data[start:at])
            at += 2
            start = at
        elif code == 0xFF:
            at += 1
        else:
            out.append(data[start:at])
            break
    return [p.replace(b"\xff\x00", b"\xff") for p in out]


def _scan(data: bytes, at: int, parts: list[Part], chosen: list[tuple[int, int, int]], codes: dict, interval: int, size: tuple[int, int], blocks: list[np.ndarray]) -> None:
    """Coefficients of a scan into ``blocks``, one array a component (rows, columns, 64)."""
    wide, high = max(p.across for p in parts), max(p.down for p in parts)
    if len(chosen) == 1:
        p = parts[chosen[0][0]]
        units = [(chosen[0], 1, 1)]
        columns, rows = (-(-(-(-n * f // most)) // 8) for n, f, most in ((size[0], p.across, wide), (size[1], p.down, high)))
    else:
        units = [(c, parts[c[0]].across, parts[c[0]].down) for c in chosen]
        columns, rows = -(-size[0] // (8 * wide)), -(-size[1] // (8 * high))
    total, done = columns * rows, 0
    for part in _scan_parts(data, at):
        bits, last = _Bits(part), [0] * len(parts)
        for unit in range(done, min(total, done + interval) if interval else total):
            row, column = divmod(unit, columns)
            for (i, dc, ac), across, down in units:
                first, rest = codes[0, dc], codes[1, ac]
                for b in range(across * down):
                    block = bits.block(first, rest)
                    last[i] += block[0]
                    block[0] = last[i]
                    blocks[i][row * down + b // across, column * across + b % across] = block
        done += interval or total
        if done >= total:
            return
    raise Unreadable("scan ends early")


def decode(data: bytes) -> tuple[int, int, int, bytes]:
    """``(width, height, channels, samples)``: grey or RGB, a byte a sample.

    Sequential Huffman pictures of 8 bits; progressive, lossless and arithmetic
    ones raise ``Unreadable``, as damaged ones do.  Colours are those of the
    file's Adobe marker; without one three components are luminance and
    chrominance, four are inks.
    """
    try:
        return _decode(data)
    except (IndexError, KeyError, struct.error) as e:
        raise Unreadable(f"torn segment: {e}") from e


def _decode(data: bytes) -> tuple[int, int, int, bytes]:
    tables: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], list] = {}
    parts: list[Part] = []
    blocks: list[np.ndarray] = []
    interval, adobe, size, scanned = 0, None, (0, 0), set()
    for marker, body, behind in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                raw = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1)
                tables[body[at] & 15] = raw.astype(np.float64)
                at += 129 if wide else 65
        elif marker == 0xC4:
            at = 0
            while at + 17 <= len(body):
                counts = body[at + 1 : at + 17]
                codes[body[at] >> 4, body[at] & 15] = _lookup(counts, body[at + 17 : at + 17 + sum(counts)])
                at += 17 + sum(counts)
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not high or not wide or n not in (1, 3, 4):
                raise Unreadable(f"{bits} bits, {n} components, {wide} x {high}")
            size = (wide, high)
            parts = [Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if any(not 1 <= f <= 4 for p in parts for f in (p.across, p.down)):
                raise Unreadable("bad sampling factors")
            most = max(p.across for p in parts), max(p.down for p in parts)
            blocks = [np.zeros((-(-high // (8 * most[1])) * p.down, -(-wide // (8 * most[0])) * p.across, 64), np.int32) for p in parts]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Unreadable(f"frame type {marker - 0xC0}")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            place = {p.ident: i for i, p in enumerate(parts)}
            chosen = [(place[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            _scan(data, behind, parts, chosen, codes, interval, size, blocks)
            scanned |= {i for i, _, _ in chosen}
            if len(scanned) == len(parts):
                break
    if not parts or len(scanned) < len(parts):
        raise Unreadable("no picture")
    planes = [_plane(b, tables[p.table], p, parts, size) for b, p in zip(blocks, parts)]
    samples = _colours(np.stack(planes, axis=-1), adobe)
    return size[0], size[1], samples.shape[-1], samples.tobytes()


def _plane(blocks: np.ndarray, table: np.ndarray, part: Part, parts: list[Part], size: tuple[int, int]) -> np.ndarray:
    """Samples of a component at the size of the picture."""
    rows, columns = blocks.shape[:2]
    square = np.zeros((rows, columns, 64))
    square[..., zigzag()] = blocks * table
    c = cosines()
    pixels = np.einsum("ki,rckl,lj->rcij", c, square.reshape(rows, columns, 8, 8), c, optimize=True)
    whole = np.clip(np.rint(pixels + 128), 0, 255).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
    down, across = max(p.down for p in parts), max(p.across for p in parts)
    y, x = (np.arange(n) * f // most for n, f, most in ((size[1], part.down, down), (size[0], part.across, across)))
    return whole[y][:, x]


def _colours(planes: np.ndarray, adobe: int | None) -> np.ndarray:
    n = planes.shape[-1]
    if n == 1:
        return planes.astype(np.uint8)
    if (n == 3 and adobe != 0) or (n == 4 and adobe == 2):
        y, b, r = planes[..., 0], planes[..., 1] - 128, planes[..., 2] - 128
        rgb = np.stack((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b), axis=-1)
        planes = np.concatenate((np.clip(np.rint(rgb), 0, 255), planes[..., 3:]), axis=-1)
    if n == 4:
        from .codecs import cmyk_to_rgb

        return cmyk_to_rgb(255 - planes if adobe is not None else planes)
    return planes.astype(np.uint8)


# ---------------------------------------------------------------- writing

#: Tables for writing: all symbols of one length, which is simple and never the shortest.
_DC = (bytes([0, 0, 0, 12]) + bytes(12), bytes(range(12)))
_AC_SYMBOLS = bytes([0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))])
_AC = (bytes(7) + bytes([len(_AC_SYMBOLS)]) + bytes(8), _AC_SYMBOLS)


def _write_number(v: int) -> tuple[int, str]:
    n = abs(v).bit_length()
    return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""


@cache
def _written() -> tuple[dict[int, str], dict[int, str], dict[int, str]]:
    """Codes for symbols of the rest of a block, and code and bits of every number that has some: as a block's first, and with no zeros before it."""
    first, rest = ({s: f"{code:0{n}b}" for code, n, s in _codes(*t)} for t in (_DC, _AC))
    numbers = [(v, *_write_number(v)) for v in range(-2047, 2048)]
    return rest, {v: first[n] + digits for v, n, digits in numbers}, {v: rest[n] + digits for v, n, digits in numbers if v and n in rest}


def _within_one(found: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """``found`` with coefficients rounded the other way where the errors of a block add up to more than one in a sample.

    That is about one sample in twenty million of text bytes.  Of the coefficients the one
    that leaves the smallest error is changed, and another while that makes it smaller.
    """
    c = cosines()
    waves = np.einsum("ki,lj->klij", c, c).reshape(64, 64)
    errors = (found - exact) @ waves
    # Errors below 1.5 are rounded to one; the margin is for other orders of summing.
    for i in np.flatnonzero(np.abs(errors).max(axis=1) > 1.4999):
        error = errors[i]
        while (most := np.abs(error).max()) > 1.4999:
            turn = np.where(found[i] > exact[i], -1.0, 1.0)
            tried = error + turn[:, None] * waves
            k = int(np.abs(tried).max(axis=1).argmin())
            if np.abs(tried[k]).max() >= most:
                break
            found[i, k] += turn[k]
            error = tried[k]
    return found


def encode(samples: bytes, width: int, height: int, channels: int = 1, step: int = 1, restart: int = 0) -> bytes:
    """A baseline picture of grey or RGB samples; ``step`` is the quantisation of all coefficients, ``restart`` an interval in blocks.

    With a ``step`` of 1 every sample of a component is read back within one.
    """
    x = np.frombuffer(samples, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 3:
        r, g, b = (x[..., i] for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        x = np.stack((y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128), axis=-1)
    x = np.pad(x, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge") - 128
    rows, columns = x.shape[0] // 8, x.shape[1] // 8
    c = cosines()
    blocks = x.reshape(rows, 8, columns, 8, channels).transpose(0, 2, 4, 1, 3)
    exact = np.einsum("ki,rcnij,lj->rcnkl", c, blocks, c, optimize=True) / step
    found = np.rint(exact)
    if step == 1:
        found = _within_one(found.reshape(-1, 64), exact.reshape(-1, 64))
    found = found.astype(int).reshape(rows * columns, channels, 64)[..., zigzag()]
    rest, whole, near = _written()
    parts, text, last = [], [], [0] * channels
    for unit, block in enumerate(found.tolist()):
        if restart and unit and unit % restart == 0:
            parts.append("".join(text))
            text, last = [], [0] * channels
        for i, values in enumerate(block):
            text.append(whole[values[0] - last[i]])
            last[i] = values[0]
            run = 0
            for v in values[1:]:
                if not v:
                    run += 1
                    continue
                if not run:
                    text.append(near[v])
                    continue
                text.append(rest[0xF0] * (run // 16))
                n, digits = _write_number(v)
                text.append(rest[(run % 16) << 4 | n] + digits)
                run = 0
            if run:
                text.append(rest[0])
    parts.append("".join(text))
    packed = [int(t.ljust(-(-len(t) // 8) * 8, "1") or "0", 2).to_bytes(-(-len(t) // 8), "big").replace(b"\xff", b"\xff\x00") for t in parts]
    scan = b"".join(p + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(packed) else b"") for i, p in enumerate(packed))
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return b"".join((
        b"\xff\xd8", segment(0xDB, b"\0" + bytes([step] * 64)), segment(0xC0, struct.pack(">BHHB", 8, height, width, channels) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(channels))),
        segment(0xC4, b"\0" + _DC[0] + _DC[1] + b"\x10" + _AC[0] + _AC[1]), segment(0xDD, struct.pack(">H", restart)) if restart else b"",
        segment(0xDA, bytes([channels]) + b"".join(bytes([i + 1, 0]) for i in range(channels)) + b"\0\x3f\0"), scan, b"\xff\xd9"))
