"""CCITT group 3 and 4 images: rows of run lengths to bits, and back."""

from __future__ import annotations

from functools import cache
from itertools import chain, islice
from operator import lt

import numpy as np

# Codes of white and black runs of 0 to 63 pixels, of multiples of 64 up to 1728, and of those beyond for both.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 "
    "0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 "
    "00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 "
    "01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 "
    "00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 "
    "000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 "
    "000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 "
    "000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
).split()
WHITE_64 = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 "
    "011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK_64 = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 "
    "0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 "
    "0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
# The modes of two-dimensional rows; vertical ones by their distance.
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END_OF_LINE = "000000000001"
LOOK = 13
#: Modes in tables of codes, beside the distances of vertical ones.
_PASS, _HORIZONTAL = 4, 5
#: Pixels that are packed at once.
_PIXELS = 1 << 22


@cache
def run_codes(black: bool) -> dict[int, str]:
    ends, more = (BLACK, BLACK_64) if black else (WHITE, WHITE_64)
    return dict(enumerate(ends)) | {64 * (i + 1): c for i, c in enumerate(more)} | {1792 + 64 * i: c for i, c in enumerate(LONG)}


@cache
def _lookup(kind: str) -> list[tuple]:
    """For every ``LOOK`` bits the code that they begin with: ``(meaning, length)``, or a length of 0."""
    if kind == "mode":
        codes = {PASS: _PASS, HORIZONTAL: _HORIZONTAL} | {c: d for d, c in VERTICAL.items()}
    else:
        codes = {c: n for n, c in run_codes(kind == "black").items()}
    out: list[tuple] = [(None, 0)] * (1 << LOOK)
    for code, meaning in codes.items():
        spare = LOOK - len(code)
        first = int(code, 2) << spare
        out[first : first + (1 << spare)] = [(meaning, len(code))] * (1 << spare)
    return out


class Broken(ValueError):
    pass


class _Bits:
    def __init__(self, data: bytes):
        self.at, self.size = 0, 8 * len(data)
        # The 32 bits that begin with each byte, zeros beyond the end.
        self.words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(8), np.uint8), 4).copy().view(">u4").ravel().tolist()

    def peek(self, n: int) -> int:
        """The next ``n`` bits, zeros beyond the end."""
        a = self.at >> 3
        return (self.words[a] >> (32 - (self.at & 7) - n)) & ((1 << n) - 1) if a < len(self.words) else 0

    def end_of_line(self) -> bool:
        """Step over an end of line with any zeros before it, if that comes next."""
        at = self.at
        if self.peek(11):
            return False
        while self.at < self.size and not self.peek(1):
            self.at += 1
        if self.at >= self.size:
            self.at = at
            return False
        self.at += 1
        return True


def _settled(changes: list[int], columns: int) -> list[int]:
    """Changes without runs of no pixels, none beyond the row."""
    if all(map(lt, changes, islice(changes, 1, None))):
        while changes and changes[-1] >= columns:
            changes.pop()
        return changes
    out: list[int] = []
    for x in changes:
        x = min(x, columns)
        if out and out[-1] >= x:
            out.pop()
        elif x < columns:
            out.append(x)
    return out


def _run_ends(bits: _Bits, start: int, columns: int, tables: tuple, most: int | None) -> list[int]:
    """Ends of runs in the colours of ``tables`` in turn, from ``start``: ``most`` of them, or as many as fill a row."""
    words, size, at = bits.words, bits.size, bits.at
    out, end, (now, other) = [], start, tables
    while len(out) != most if most else end < columns:
        n = 64
        while n >= 64:
            n, length = now[(words[at >> 3] >> (19 - (at & 7))) & 0x1FFF]
            if not length or at + length > size:
                bits.at = at
                raise Broken
            at += length
            end += n
        out.append(end)
        now, other = other, now
    bits.at = at
    return out


def _row_1d(bits: _Bits, columns: int) -> list[int]:
    return _settled(_run_ends(bits, 0, columns, (_lookup("white"), _lookup("black")), None), columns)


def _row_2d(bits: _Bits, before: list[int], columns: int) -> list[int]:
    a0, black, out = -1, 0, []
    modes, white, dark = _lookup("mode"), _lookup("white"), _lookup("black")
    runs = ((white, dark), (dark, white))
    words, size, j = bits.words, bits.size, 0
    above = [*before, columns, columns, columns]
    while a0 < columns:
        at = bits.at
        mode, length = modes[(words[at >> 3] >> (19 - (at & 7))) & 0x1FFF]
        if not length or at + length > size:
            raise Broken
        bits.at = at + length
        if mode == _HORIZONTAL:
            out += _run_ends(bits, a0 if a0 > 0 else 0, columns, runs[black], 2)
            a0 = out[-1]
            continue
        # The first change of the row above right of a0; a vertical mode may have gone back.
        while j and above[j - 1] > a0:
            j -= 1
        while above[j] <= a0:
            j += 1
        b = j + ((j & 1) != black)
        if mode == _PASS:
            a0 = above[b + 1]
        else:
            a0 = above[b] + mode
            if a0 < 0:
                a0 = 0
            out.append(a0)
            black = 1 - black
    return _settled(out, columns)


def _packed(rows: list[list[int]], columns: int, black_is_1: bool) -> bytes:
    """Rows of bits from their changes; white pixels are 1 unless ``black_is_1``."""
    out, step = [], max(1, _PIXELS // max(1, columns))
    for start in range(0, len(rows), step):
        part = rows[start : start + step]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        marks = np.zeros(len(part) * columns, np.uint8)
        marks[np.fromiter(chain.from_iterable(part), np.int64, lengths.sum()) + np.repeat(np.arange(len(part)) * columns, lengths)] = 1
        bits = np.bitwise_xor.accumulate(marks.reshape(len(part), columns), axis=1) if columns else marks.reshape(len(part), 0)
        out.append(np.packbits(bits if black_is_1 else 1 - bits, axis=1).tobytes())
    return b"".join(out)


def decode(data: bytes, k: int = 0, columns: int = 1728, rows: int = 0, black_is_1: bool = False, byte_align: bool = False) -> bytes:
    """Rows of bits.  With ``rows`` there are so many: what the data lack is white.

    A row that cannot be read repeats the one before; reading goes on after the
    next end of line, which group 4 does not have, so there the rest is white.
    """
    bits, out, before = _Bits(data), [], []
    while (not rows or len(out) < rows) and bits.at < bits.size:
        if byte_align:
            bits.at = -(-bits.at // 8) * 8
        ends = 0
        while bits.end_of_line():
            ends += 1
            bits.at += k > 0 and bits.peek(12) == 0x800  # a tag of mixed rows that another end of line follows
        if ends >= (2 if k <= 0 else 3) or bits.at >= bits.size:
            break
        try:
            if k < 0:
                before = _row_2d(bits, before, columns)
            elif k == 0:
                before = _row_1d(bits, columns)
            else:
                tagged = bits.peek(1)
                bits.at += 1
                before = _row_1d(bits, columns) if tagged else _row_2d(bits, before, columns)
        except Broken:
            if k < 0 or bits.size - bits.at < 12:
                break
            while bits.at < bits.size and bits.peek(12) != 1:
                bits.at += 1
            if bits.at >= bits.size:
                break
        out.append(before)
    return _packed(out, columns, black_is_1) + _packed([[]], columns, black_is_1) * max(0, rows - len(out))


# ---------------------------------------------------------------- writing


def changes_of(row: bytes, columns: int) -> list[int]:
    """Places where the colour changes in a row of bits in which black is 1; the row begins white."""
    spare = max(0, 8 * len(row) - columns)
    bits = int.from_bytes(row, "big") >> spare
    marks = (bits ^ bits >> 1) << spare
    places = _places()
    return [i + p for i, byte in zip(range(0, 8 * len(row), 8), marks.to_bytes(len(row), "big")) for p in places[byte]]


@cache
def _places() -> list[tuple[int, ...]]:
    """The places of the set bits of every byte, the most significant first."""
    return [tuple(i for i in range(8) if byte >> (7 - i) & 1) for byte in range(256)]


def _run(n: int, black: bool) -> str:
    codes, out = run_codes(black), ""
    while n >= 64:
        part = min(n // 64 * 64, 2560)
        out += codes[part]
        n -= part
    return out + codes[n]


@cache
def _runs(black: bool) -> list[str]:
    """Codes of the runs of up to 2560 pixels; longer ones are ``_run``'s."""
    return [_run(n, black) for n in range(2561)]


def _write_1d(changes: list[int], columns: int) -> str:
    edges = [0, *changes, columns]
    if columns > 2560:
        return "".join(_run(b - a, bool(i & 1)) for i, (a, b) in enumerate(zip(edges, edges[1:])))
    out, now, other = [], _runs(False), _runs(True)
    for a, b in zip(edges, edges[1:]):
        out.append(now[b - a])
        now, other = other, now
    return "".join(out)


def _write_2d(before: list[int], changes: list[int], columns: int) -> str:
    out, a0, black = [], -1, 0
    runs = (_runs(False), _runs(True)) if columns <= 2560 else None
    above, own = [*before, columns, columns, columns], [*changes, columns, columns, columns]
    i = j = 0
    while a0 < columns:
        # The first changes right of a0, of this row and of the one above, from the present colour.
        while own[i] <= a0:
            i += 1
        while above[j] <= a0:
            j += 1
        a, b = i + ((i & 1) != black), j + ((j & 1) != black)
        a1, b1 = own[a], above[b]
        if above[b + 1] < a1:
            out.append(PASS)
            a0 = above[b + 1]
        elif -3 <= a1 - b1 <= 3:
            out.append(VERTICAL[a1 - b1])
            a0, black = a1, 1 - black
        else:
            a2, start = own[a + 1], a0 if a0 > 0 else 0
            if runs:
                out += (HORIZONTAL, runs[black][a1 - start], runs[1 - black][a2 - a1])
            else:
                out += (HORIZONTAL, _run(a1 - start, bool(black)), _run(a2 - a1, not black))
            a0 = a2
    return "".join(out)


def encode(rows: list[bytes], columns: int, k: int = -1, end_of_line: bool = False) -> bytes:
    """Rows of bits, black being 1, as group 4 (``k`` below 0), group 3 in one dimension (0) or with every ``k``-th row in one dimension."""
    out, before = [], []
    for i, row in enumerate(rows):
        now = changes_of(row, columns)
        if k < 0:
            out.append(_write_2d(before, now, columns))
        elif k == 0:
            out.append((END_OF_LINE if end_of_line else "") + _write_1d(now, columns))
        else:
            one = i % k == 0
            out.append(END_OF_LINE + ("1" if one else "0") + (_write_1d(now, columns) if one else _write_2d(before, now, columns)))
        before = now
    out.append(END_OF_LINE * 2 if k < 0 else END_OF_LINE * 6 if k == 0 else (END_OF_LINE + "1") * 6)
    text = "".join(out)
    return int(text.ljust(-(-len(text) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(text) // 8), "big")
