"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1 is a minimal perfect hash over the vocabulary (hash-and-displace): a
pre-token that is a vocabulary entry is resolved whole.  Tier 2, for the
misses, merges bytes by rank with a heap over a doubly linked list, so a
pre-token of n bytes costs O(n log n) however long it is.  Tasks remember the
ids of the pre-tokens they have met, in a bounded memo.

Defined results: a null text is encoded as the empty text (no ids; the digests
are those of no bytes); rows are encoded alone, so ties, repeated rows and an
empty table need no rule; other columns are ignored.  A vocabulary must hold
all 256 single bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of a task's memo of pre-tokens; it starts anew when full.
MEMO = 400_000
#: Longer pre-tokens are encoded but not remembered.
MEMO_BYTES = 64


class PerfectHash:
    """Minimal perfect hash of byte strings to their positions.

    Bucket seeds are searched largest bucket first; a bucket of one key needs no
    search and stores the free slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes], load: int = 2):
        import xxhash

        self._hash = xxhash.xxh3_64_intdigest
        self.n = n = len(keys)
        self.m = m = max(1, n // load)
        buckets: list[list[int]] = [[] for _ in range(m)]
        h = [self._hash(k) for k in keys]
        for i, x in enumerate(h):
            buckets[x % m].append(i)
        self.seed = [0] * m
        self.slot = [-1] * max(n, 1)
        order = sorted(range(m), key=lambda b: -len(buckets[b]))
        for b in order:
            own = buckets[b]
            if len(own) < 2:
                break
            seed = 0
            while True:
                places = [self._place(h[i], seed) for i in own]
                if len(set(places)) == len(places) and all(self.slot[p] < 0 for p in places):
                    break
                seed += 1
            self.seed[b] = seed
            for i, p in zip(own, places):
                self.slot[p] = i
        free = (p for p in range(n) if self.slot[p] < 0)
        for b in order:
            if len(buckets[b]) == 1:
                p = next(free)
                self.seed[b], self.slot[p] = -1 - p, buckets[b][0]
        self.keys = keys

    def _place(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int:
        """Position of ``key``, or -1: the one candidate slot is compared with the key itself."""
        if not self.n:
            return -1
        h = self._hash(key)
        seed = self.seed[h % self.m]
        i = self.slot[self._place(h, seed) if seed >= 0 else -1 - seed]
        return i if self.keys[i] == key else -1


class Vocabulary:
    def __init__(self, lines: list[bytes]):
        ranked = [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in lines if x.strip())]
        self.ranks = dict(ranked)
        self.bytes_of = {r: t for t, r in ranked}
        keys = [t for t, _ in ranked]
        self._ids = [r for _, r in ranked]
        self.whole = PerfectHash(keys)
        if len(self.bytes_of) != len(keys) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("ranks must be distinct and cover every single byte")

    def encode(self, piece: bytes) -> list[int]:
        at = self.whole.get(piece)
        return [self._ids[at]] if at >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is swallowed
        before = list(range(-1, n - 1))
        bits = n.bit_length()
        mask = (1 << bits) - 1
        # A heap entry is rank, start and end of the merged part, packed into one integer.
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            stop, i = x & mask, x >> bits & mask
            mid = end[i]
            if not mid or mid >= stop or end[mid] != stop:
                continue  # one of the two parts has changed since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                e = end[stop]
                if (r := rank(piece[i:e])) is not None:
                    heappush(heap, (r << bits | i) << bits | e)
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heappush(heap, (r << bits | p) << bits | stop)
        ranks = self.ranks
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


@lru_cache(maxsize=2)
def load(vocab: str) -> Vocabulary:
    """The vocabulary at a path that every Python worker can open (it is installed with the tokenizers)."""
    with open(vocab, "rb") as f:
        return Vocabulary(f.read().splitlines())


#: How the standard library's engine writes the pattern's Unicode classes for text within Latin-1.
_LATIN = {"L": "A-Za-zªµºÀ-ÖØ-öø-ÿ", "N": "0-9²³¹¼-¾", "s": "\\t-\\r \x85\xa0"}
_NOT_LATIN = re.compile("[^\x00-\xff]")


def splitter(pattern: str):
    """``text -> pre-tokens``.  Latin-1 text takes the faster engine with its classes spelled out."""
    import regex

    wide = regex.compile(pattern).findall
    # Within a class only the members are spelled; outside, a class of its own.
    narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_LATIN['s']}{_LATIN['L']}{_LATIN['N']}]")
    for k in ("L", "N"):
        narrow = narrow.replace(rf"\p{{{k}}}", f"[{_LATIN[k]}]")
    narrow = narrow.replace(r"\s", f"[{_LATIN['s']}]").replace(r"\S", f"[^{_LATIN['s']}]")
    if r"\p" in narrow:
        return wide
    latin = re.compile(narrow).findall
    return lambda text: wide(text) if _NOT_LATIN.search(text) else latin(text)


class _Memo(dict):
    """pre-token -> its ids as text joined by spaces.

    One for each Python worker, kept from task to task.  Two generations bound
    it: when the young one is full it becomes the old one, and what is asked
    for again moves back.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.old = vocab, {}

    def __missing__(self, piece: str) -> str:
        ids = self.old.get(piece)
        if ids is None:
            ids = " ".join(map(str, self.vocab.encode(piece.encode("utf-8", "replace"))))
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _memo(vocab_path: str) -> _Memo:
    return _Memo(load(vocab_path))


def encode_batches(vocab_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(vocab_path)
        split, memo = splitter(pattern), _memo(vocab_path)
        back = {str(r): t for r, t in vocab.bytes_of.items()}
        for batch in batches:
            n, ids_sha, out_sha = [], [], []
            for text in batch.column(1):
                ids = " ".join(map(memo.__getitem__, split(text.as_py() or "")))
                decoded = b"".join(map(back.__getitem__, ids.split(" "))) if ids else b""
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                out_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def tokenize_batches(vocab_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, memo = splitter(pattern), _memo(vocab_path)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1):
                ids = " ".join(map(memo.__getitem__, split(text.as_py() or "")))
                row = np.array(ids.split(" "), dtype=np.int32) if ids else np.empty(0, np.int32)
                flat.append(row)
                ends.append(ends[-1] + len(row))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"]
            )

    return run


def detokenize_batches(vocab_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = load(vocab_path).bytes_of
        for batch in batches:
            raw = [b"".join(map(back.__getitem__, ids.as_py() or ())) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return run


def encode(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` for each row of ``docs(doc_id, text)``; no shuffle."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(tokenize_batches(vocab_path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``doc_id, bytes`` for each row of ``encoded(doc_id, ids)``."""
    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(detokenize_batches(vocab_path), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """Encode and decode each text in one pass; counts and digests of both."""
    return docs.select("doc_id", "text").mapInArrow(encode_batches(vocab_path, pattern), SCHEMA)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
