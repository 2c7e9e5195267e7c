"""Word shingles of whole texts as sorted arrays of 64-bit hashes, a block of texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Texts are hashed together up to so many bytes; a longer text is a block of its own.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_K = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_cache: dict[int, np.ndarray] = {}


def _upto(base: int, n: int) -> np.ndarray:
    have = _cache.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n, BLOCK + 4096))
        if n <= 4 * BLOCK:
            _cache[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(raws: list[bytes], k: int) -> list[np.ndarray]:
    joined = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    edge = np.diff(np.concatenate([[False], ~_SPACE[joined]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(joined)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[joined] * _upto(_BASE, n), out=sums[1:])
    word = mix((sums[end] - sums[start]) * _upto(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))
    at = np.searchsorted(start, begins)
    counts = np.diff(np.concatenate([at, [len(start)]]))
    full = np.zeros(0, np.uint64)
    if len(word) >= k:
        full = word[: len(word) - k + 1].copy()
        for i in range(1, k):
            full = full * _K + word[i : len(word) - k + 1 + i]
        full = mix(full)
    out = []
    for a, c in zip(at.tolist(), counts.tolist()):
        if c >= k:
            out.append(np.unique(full[a : a + c - k + 1]))
        elif c:
            h = np.uint64(c)
            for w in word[a : a + c]:
                h = h * _K + w
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], k: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles, A-Z lower-cased.

    Words are runs of characters other than U+0020 and U+0009 to U+000D.  A text
    of fewer than ``k`` words has its whole sequence as one; without words, none.
    """
    old = np.seterr(over="ignore")
    try:
        block, size = [], 0
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass").lower()
            if block and size + len(raw) > BLOCK:
                yield from _block(block, k)
                block, size = [], 0
            block.append(raw)
            size += len(raw) + 1
        if block:
            yield from _block(block, k)
    finally:
        np.seterr(**old)


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``most`` bytes of text, so that a task's arrays stay small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if a < z:
                yield batch.slice(a, z - a)


def signature(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))
