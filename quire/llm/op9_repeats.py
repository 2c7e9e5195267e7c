"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of enhanced suffix arrays.

A byte is removed if a ``LENGTH``-byte string that covers it also starts in a
document with a smaller doc_id.  Texts are UTF-8 bytes; matches never cross documents.

Not every suffix of the corpus can be sorted, so only those that may repeat are:

1. *Anchors.*  Every 50-byte string elects one of its 16-byte grams, the
   leftmost of least hash; equal strings elect the same one.  Runs of strings
   with one anchor form a context (50 to 84 bytes).  About one byte in eighteen
   is an anchor.
2. *Classes.*  Contexts travel as two hashes and a place, packed, dealt by the
   anchor's hash.  Equal contexts form a class: all but those of its smallest
   doc_id are repeats as they stand.  In a batch only the smallest travels on,
   so a passage that many documents hold costs one row a batch.  Of a context
   that one text repeats the first travels, whatever is found of it holds for
   the others too, so a line that a text repeats is one context everywhere.
3. *Suffix arrays.*  Only anchors with several classes (where copies begin, end
   or were edited) need their bytes.  Their contexts are fetched and meet again
   by anchor; the suffixes of at least 50 bytes are sorted, with common-prefix
   lengths and left neighbours.  A stack scan yields the intervals of the
   common-prefix tree; those whose left neighbours differ are maximal repeats,
   given with all their occurrences.
   Anchors with very many classes (a common line amid different text) are dealt
   by the 50-byte strings themselves instead, so that no task gets them all.
4. *Removal.*  Ranges are merged per document and cut out of its bytes.

Questions join the documents by shuffle; the ranges at the end are broadcast to
their scan up to ``BROADCAST_BYTES``, beyond that they too are joined by shuffle.

Defined results: null texts are empty; texts below 50 bytes keep everything;
repeats within one doc_id, repeated rows of it included, are not removed; texts
of any length are read whole, in pieces; an empty table gives no rows; other
columns are ignored.  Names of contexts are hashes of 80 bits and more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, stage, table
from .shingles import mix

LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1
WIDEST = LENGTH + WINDOW - 1
#: Texts are hashed together up to so many bytes; a longer text is cut into pieces that overlap by LENGTH - 1.
BLOCK = 1 << 20
#: Texts whose anchors are sorted together in a task.
PORTION = 6 << 20
#: An anchor with more classes in a batch, or in all, is dealt by strings instead.
MANY_IN_BATCH, MANY = 64, 5_000
#: Bytes of text for each bucket of anchors; their records take four fifths of that.
BUCKET_TEXT = 20 << 20
BROADCAST_BYTES = 64 << 20

_BYTE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
_R = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_PLACE = np.uint64((1 << 24) - 1)
_ORDER = np.uint64(0xBF58476D1CE4E5B9)
#: Stands for the classes that a batch has sent another way.
_MARK = np.uint64((1 << 40) - 1)
_FORTY = np.uint64((1 << 40) - 1)


# ---------------------------------------------------------------- anchors


def _pieces(raws: list[bytes], most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (text number, offset, bytes)."""
    block, size = [], 0
    for i, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        for at in range(0, max(1, len(raw) - LENGTH + 1), most):
            part = raw[at : at + most + LENGTH - 1] if len(raw) > most else raw
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((i, at, part))
            size += len(part)
            if part is raw:
                break
    if block:
        yield block


def anchors(raws: list[bytes], most: int = BLOCK) -> tuple[np.ndarray, ...]:
    """(text number, first string, last string less first, anchor hash, context hash) of every anchor of the texts."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    with np.errstate(over="ignore"):
        for block in _pieces(raws, most):
            lengths = np.fromiter((len(x[2]) for x in block), np.int64, len(block))
            begins = np.cumsum(lengths) - lengths
            g = _BYTE[np.frombuffer(b"".join(x[2] for x in block), np.uint8)]
            for step, r in zip((1, 2, 4, 8), _R):
                g = g[:-step] * r + g[step:]
            key = ((g * _ORDER) & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
            for step in (1, 2, 4, 8, 16):
                key = np.minimum(key[:-step], key[step:])
            key = np.minimum(key[: 32 - WINDOW], key[WINDOW - 32 :]) & _PLACE
            fits = np.ones(lengths.sum(), bool)
            for e in (begins + lengths).tolist():
                fits[e - LENGTH + 1 : e] = False
            starts = np.flatnonzero(fits)
            at = key[starts]
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            first, last = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
            at = at[new].astype(np.int64)
            size = last - first + LENGTH
            cls = (size * 128 + at - first).astype(np.uint64)
            for o in (0, 16, 32, 48, 64, WIDEST):
                cls = cls * _R[3] + g[first + np.minimum(o, size - GRAM)]
            text = np.searchsorted(begins, first, "right") - 1
            shift = np.fromiter((x[1] for x in block), np.int64, len(block)) - begins
            for x, y in zip(out, (np.fromiter((x[0] for x in block), np.int64, len(block))[text], first + shift[text], last - first, mix(g[at]), mix(cls))):
                x.append(y)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds))


# ---------------------------------------------------------------- packed rows


def _planes(x: np.ndarray, kind) -> bytes:
    """Bytes of like weight together, so that the codec of the shuffle finds the runs."""
    x = np.ascontiguousarray(x.astype(kind))
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(w, -1).T).view(kind).ravel()


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


COVER, ANCHOR, ASK, ECHO = 0, 1, 2, 3
PACKED = "bucket int, kind byte, hot boolean, fp binary, cls binary, doc binary, ver binary, first binary, last binary"
_ARROW = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int8()), ("hot", pa.bool_()), *((n, pa.binary()) for n in ("fp", "cls", "doc", "ver", "first", "last"))]
)


def _deal(bucket, kind, hot, fp, cls, doc, ver, first, last) -> list[tuple]:
    """Packed rows, one for each bucket."""
    by = np.argsort(bucket, kind="stable")
    b = bucket[by]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, int)
    rows = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        i = by[lo:hi]
        rows.append((
            int(b[lo]), kind, hot, None if fp is None else _five(fp[i]), None if cls is None else _five(cls[i]),
            _planes(doc[i], np.int64), _planes(ver[i], np.uint32), _planes(first[i], np.uint32), _planes(last[i], np.uint32),
        ))
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ARROW)], schema=_ARROW)


def _unpack(t, kind: int, hot=None):
    """Arrays (fp, cls, doc, ver, first, last) of all packed rows of a kind in a table."""
    rows = [r for r in t.to_pylist() if r["kind"] == kind and (hot is None or r["hot"] == hot)]
    join = lambda n, f, k: np.concatenate([f(r.get(n)) for r in rows]) if rows else np.zeros(0, k)
    return (
        join("fp", lambda b: _unfive(b or b""), np.uint64), join("cls", lambda b: _unfive(b or b""), np.uint64),
        join("doc", lambda b: _unplanes(b, np.int64), np.int64), join("ver", lambda b: _unplanes(b, np.uint32), np.uint32),
        join("first", lambda b: _unplanes(b, np.uint32), np.uint32).astype(np.int64), join("last", lambda b: _unplanes(b, np.uint32), np.uint32).astype(np.int64),
    )


FLAT = "kind byte, hot boolean, fp long, doc long, ver long, first long, last long"
_FLAT = pa.schema([("kind", pa.int8()), ("hot", pa.bool_()), ("fp", pa.int64()), ("doc", pa.int64()), ("ver", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _flat(kind: int, hot: bool, fp, doc, ver, first, last) -> pa.Table:
    n = len(doc)
    return pa.table(
        [
            pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, hot)), pa.array(np.zeros(n, np.int64) if fp is None else fp.view(np.int64)),
            pa.array(doc), pa.array(ver.astype(np.int64)), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)),
        ],
        schema=_FLAT,
    )


def _some_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """One bucket for rows that only pass through, so that a batch sends one of them."""
    with np.errstate(over="ignore"):
        return np.full(len(doc), int(mix(doc[:1].view(np.uint64))[0] % np.uint64(buckets)) if len(doc) else 0, np.int64)


def _merged(doc, ver, first, last):
    """Ranges of string starts, those that touch or overlap joined."""
    by = np.lexsort((first, ver, doc))
    doc, ver, first, last = doc[by], ver[by], first[by], last[by]
    if not len(doc):
        return doc, ver, first, last
    own = np.r_[True, (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1])]
    # Running maximum within a text: texts are set apart by an offset larger than any place.
    lift = np.cumsum(own) * np.int64(1 << 33)
    top = np.maximum.accumulate(last + lift)
    new = np.r_[True, first[1:] + lift[1:] > top[:-1] + 1]
    at = np.flatnonzero(new)
    return doc[at], ver[at], first[at], (top - lift)[np.r_[at[1:], len(doc)] - 1]


def _version(raw: bytes) -> int:
    """Tells different texts of one doc_id apart."""
    import xxhash

    return xxhash.xxh32_intdigest(raw)


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]


# ---------------------------------------------------------------- step 1 and 2


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of about ``PORTION`` bytes, so that a task's arrays stay small."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raws, begin, size = [], 0, 0
        for i, t in enumerate(batch.column(1)):
            raws.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(raws[-1])
            if size >= PORTION:
                yield ids[begin : i + 1], raws
                raws, begin, size = [], i + 1, 0
        if raws:
            yield ids[begin:], raws


def _repeated_within(text: np.ndarray, first: np.ndarray, fp: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts a text has had before, and the number of the first of each."""
    by = np.lexsort((first, text, cls, fp))
    new = np.r_[True, (text[by][1:] != text[by][:-1]) | (cls[by][1:] != cls[by][:-1]) | (fp[by][1:] != fp[by][:-1])]
    again, original = np.zeros(len(by), bool), np.zeros(len(by), np.int64)
    again[by] = ~new
    original[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return again, original


def _find_anchors(buckets: int, many_in_batch: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in _portions(batches):
            text, first, span, fp, cls = anchors(raws, block)
            if not len(text):
                continue
            version = np.fromiter(map(_version, raws), np.uint32, len(raws))
            doc, ver, last = ids[text], version[text], first + span
            rows = []
            # A context that a text repeats is asked about once; the others have the ranges that it has.
            again, original = _repeated_within(text, first, fp, cls)
            if again.any():
                e = original[again]
                rows += _deal(_some_bucket(doc[again], buckets), ECHO, False, first[again].astype(np.uint64), None, doc[again], ver[again], first[e], last[e])
                first, last, fp, cls, doc, ver = (x[~again] for x in (first, last, fp, cls, doc, ver))
            # A class keeps its smallest doc_id; the others are repeats.
            by = np.lexsort((doc, cls, fp))
            edge = np.r_[True, (cls[by][1:] != cls[by][:-1]) | (fp[by][1:] != fp[by][:-1])]
            least = doc[by][np.flatnonzero(edge)][np.cumsum(edge) - 1]
            later = np.zeros(len(doc), bool)
            later[by] = doc[by] > least
            if later.any():
                d, v, a, z = _merged(doc[later], ver[later], first[later], last[later])
                rows += _deal(_some_bucket(d, buckets), COVER, False, None, None, d, v, a, z)
            # Anchors with very many classes in this batch are asked for at once; a mark tells the others of them.
            lead_fp = fp[by][edge]
            h, n = np.unique(lead_fp, return_counts=True)
            many = h[n > many_in_batch]
            often = np.isin(fp, many) & ~later if len(many) else np.zeros(len(doc), bool)
            stay = ~later & ~often
            if often.any():
                rows += _deal(_some_bucket(doc[often], buckets), ASK, True, fp[often], None, doc[often], ver[often], first[often], last[often])
                marks = np.zeros(len(many), np.int64)
                rows += _deal((many % np.uint64(buckets)).astype(np.int64), ANCHOR, False, many >> np.uint64(24), np.full(len(many), _MARK), marks, marks, marks, marks)
            f = fp[stay]
            rows += _deal((f % np.uint64(buckets)).astype(np.int64), ANCHOR, False, f >> np.uint64(24), cls[stay] & _FORTY, doc[stay], ver[stay], first[stay], last[stay])
            yield _batch(rows)

    return run


def _passed(t: pa.Table) -> list[pa.Table]:
    """Rows of other kinds than anchors, unpacked."""
    out = []
    for kind, hot in ((COVER, False), (ECHO, False), (ASK, True)):
        fp, _, doc, ver, first, last = _unpack(t, kind)
        out.append(_flat(kind, hot, None if kind == COVER else fp, doc, ver, first, last))
    return out


def _resolve(many: int):
    """Per bucket: repeats by class, and the contexts whose bytes are needed."""

    def run(t: pa.Table) -> pa.Table:
        out = _passed(t)
        fp, cls, doc, ver, first, last = _unpack(t, ANCHOR)
        if len(fp):
            by = np.lexsort((doc, cls, fp))
            fp, cls, doc, ver, first, last = (x[by] for x in (fp, cls, doc, ver, first, last))
            new_fp = np.r_[True, fp[1:] != fp[:-1]]
            new_cls = new_fp | np.r_[True, cls[1:] != cls[:-1]]
            mark = cls == _MARK
            number = np.cumsum(new_cls) - 1
            least = doc[np.flatnonzero(new_cls)][number]
            later = (doc > least) & ~mark
            out.append(_flat(COVER, False, None, *_merged(doc[later], ver[later], first[later], last[later])))
            group = np.cumsum(new_fp) - 1
            at = np.flatnonzero(new_fp)
            lows, tops = np.minimum.reduceat(least, at), np.maximum.reduceat(least, at)
            marked = np.logical_or.reduceat(mark, at)
            classes = np.add.reduceat(new_cls.astype(np.int64), at)
            ask = ((lows < tops) | marked)[group] & ~later & ~mark
            hot = ((classes > many) | marked)[group]
            whole = (fp << np.uint64(24)) ^ np.uint64(t.column("bucket")[0].as_py())
            for is_hot in (False, True):
                i = ask & (hot == is_hot)
                with np.errstate(over="ignore"):
                    out.append(_flat(ASK, is_hot, mix(whole[i]), doc[i], ver[i], first[i], last[i]))
        return pa.concat_tables(out)

    return run


# ---------------------------------------------------------------- side tables per document


def _echoed(ranges: tuple[np.ndarray, ...], doc: np.ndarray, ver: np.ndarray, first: np.ndarray, last: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """What ``ranges`` (merged) hold of the strings ``first`` to ``last``, moved to where the text has them again, from ``other`` on."""
    d, v, a, z = ranges
    _, number = np.unique(np.stack((np.r_[d, doc], np.r_[v, ver].astype(np.int64)), axis=1), axis=0, return_inverse=True)
    lift = number.ravel() * np.int64(1 << 33)
    of, to = lift[: len(d)], lift[len(d) :]
    low, high = np.searchsorted(z + of, first + to, "left"), np.searchsorted(a + of, last + to, "right")
    n = np.maximum(high - low, 0)
    e = np.repeat(np.arange(len(doc)), n)
    r = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
    shift = (other - first)[e]
    return doc[e], ver[e], np.maximum(a[r], first[e]) + shift, np.minimum(z[r], last[e]) + shift


def _per_doc(kind: int):
    """One row a doc_id: its ranges or its questions, as an array of fixed records."""

    def run(t: pa.Table) -> pa.Table:
        kinds = (np.int64, np.uint32, np.int64, np.int64)
        doc, ver, first, last = (t.column(n).to_numpy().astype(k) for n, k in zip(("doc", "ver", "first", "last"), kinds))
        if kind == COVER:
            echo = t.column("kind").to_numpy() == ECHO
            ranges = _merged(doc[~echo], ver[~echo], first[~echo], last[~echo])
            if echo.any():
                more = _echoed(ranges, doc[echo], ver[echo], first[echo], last[echo], t.column("fp").to_numpy()[echo])
                ranges = _merged(*(np.concatenate(x) for x in zip(ranges, more)))
            doc, ver, first, last = ranges
            rec = np.rec.fromarrays([ver, first.astype(np.uint32), last.astype(np.uint32)], dtype=_RANGE)
        else:
            hot, fp = t.column("hot").to_numpy().astype(np.uint8), t.column("fp").to_numpy().view(np.uint64)
            rec = np.rec.fromarrays([ver, first.astype(np.uint32), (last - first).astype(np.uint8), hot, fp], dtype=_QUESTION)
            by = np.argsort(doc, kind="stable")
            doc, rec = doc[by], rec[by]
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
        ends = np.r_[at[1:], len(doc)] if len(doc) else at
        return pa.table({"doc_id": pa.array(doc[at]), "data": pa.array([rec[a:z].tobytes() for a, z in zip(at, ends)], pa.binary())})

    return run


_RANGE = np.dtype([("ver", "<u4"), ("first", "<u4"), ("last", "<u4")])
_QUESTION = np.dtype([("ver", "<u4"), ("first", "<u4"), ("span", "u1"), ("hot", "u1"), ("fp", "<u8")])


def _beside(docs: DataFrame, side: DataFrame, work, schema: str, most: int) -> DataFrame:
    """``work(batches of (doc_id, text, data or null))`` over all documents."""
    size = side.agg(F.sum(F.octet_length("data") + 16)).first()[0] or 0
    if size <= most:
        known = docs.sparkSession.sparkContext.broadcast({r.doc_id: bytes(r.data) for r in side.toLocalIterator()})

        def run(batches):
            get = known.value.get
            return work(
                pa.RecordBatch.from_arrays([*b.columns, pa.array([get(x) for x in b.column(0).to_pylist()], pa.binary())], names=["doc_id", "text", "data"])
                for b in batches
            )

        return docs.mapInArrow(run, schema)
    return docs.join(side, "doc_id", "left").select("doc_id", "text", "data").mapInArrow(work, schema)


# ---------------------------------------------------------------- step 3

CONTEXTS = "bucket int, kind byte, keys binary, bytes binary, sizes binary, doc binary, ver binary, first binary, last binary"
#: Contexts whose suffixes are sorted together; those of one anchor always are.
TOGETHER = 4_000


def _fetch(buckets: int):
    """Contexts that were asked for, dealt by anchor; of those asked for by strings, the strings, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, texts, docs, vers, firsts, hots = [], [], [], [], [], []
            for d, raw, data in zip(batch.column(0).to_pylist(), _raws(batch), batch.column(2)):
                if data.as_py() is None:
                    continue
                q = np.frombuffer(data.as_py(), _QUESTION)
                v = _version(raw)
                for first, span, hot, fp in q[q["ver"] == v][["first", "span", "hot", "fp"]].tolist():
                    if hot:
                        for p in range(first, first + span + 1):
                            s = raw[p : p + LENGTH]
                            keys.append(xxhash.xxh3_64_intdigest(s))
                            texts.append(s)
                            firsts.append(p)
                        n = span + 1
                    else:
                        keys.append(fp)
                        texts.append(raw[first : first + span + LENGTH])
                        firsts.append(first)
                        n = 1
                    docs += [d] * n
                    vers += [v] * n
                    hots += [hot] * n
            if not keys:
                continue
            key, doc, ver = np.array(keys, np.uint64), np.array(docs, np.int64), np.array(vers, np.uint32)
            first, hot = np.array(firsts, np.int64), np.array(hots, bool)
            rows = []
            keep = np.ones(len(key), bool)
            if hot.any():
                i = np.flatnonzero(hot)
                i = i[np.lexsort((doc[i], key[i]))]
                edge = np.r_[True, key[i][1:] != key[i][:-1]]
                later = i[doc[i] > doc[i][np.flatnonzero(edge)][np.cumsum(edge) - 1]]
                keep[later] = False
                if len(later):
                    d, v, a, z = _merged(doc[later], ver[later], first[later], first[later])
                    for b, _, _, _, _, *rest in _deal(_some_bucket(d, buckets), COVER, False, None, None, d, v, a, z):
                        rows.append((b, COVER, None, None, None, *rest))
            b = (key % np.uint64(buckets)).astype(np.int64)
            chosen = np.flatnonzero(keep)
            chosen = chosen[np.argsort(b[chosen], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, b[chosen][1:] != b[chosen][:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                i = chosen[lo:hi]
                own = [texts[x] for x in i]
                rows.append((
                    int(b[i[0]]), ANCHOR, (key[i] >> np.uint64(32)).astype(np.uint32).tobytes(), b"".join(own), bytes(map(len, own)), _planes(doc[i], np.int64), _planes(ver[i], np.uint32), _planes(first[i], np.uint32), None,
                ))
            kinds = (pa.int32(), pa.int8(), *[pa.binary()] * 7)
            names = ["bucket", "kind", "keys", "bytes", "sizes", "doc", "ver", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def suffix_array(strings: list[bytes], least: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Enhanced suffix array of the suffixes of ``strings`` with at least ``least`` bytes.

    (string number, offset, common prefix with the one before, left neighbour);
    a left neighbour outside the string counts as different from all others.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = np.maximum(sizes - least + 1, 0)
    number = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    width = int(sizes.max(initial=least))
    data = np.frombuffer(b"".join(strings) + b"\0" * width, np.uint8)
    begin = (np.cumsum(sizes) - sizes)[number] + offset
    size = sizes[number] - offset
    rows = data[begin[:, None] + np.arange(width)]
    rows[np.arange(width) >= size[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable") if len(rows) else np.zeros(0, int)
    rows, size = rows[order], size[order]
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(1), width, same.argmin(1)) if len(rows) else np.zeros(0, int)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    left = np.where(offset > 0, data[np.maximum(begin - 1, 0)].astype(np.int64), -1 - np.arange(len(begin)))[order]
    return number[order], offset[order], np.r_[0, common][: len(order)], left


def maximal_repeats(common: np.ndarray, left: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(length, begin, end) of the intervals of the common-prefix tree that are maximal repeats.

    A stack scan closes an interval where the common prefix falls below its own;
    it is maximal if its left neighbours differ.
    """
    lcp, lefts, n = common.tolist(), left.tolist(), len(common)
    # Entries: length, begin, the one left neighbour or None once they differ.
    stack: list[list] = []
    for i in range(1, n + 1):
        here = lcp[i] if i < n else 0
        begin, side = i - 1, lefts[i - 1]
        while stack and stack[-1][0] > here:
            length, start, one = stack.pop()
            one = one if one == side else None
            if one is None:
                yield length, start, i
            begin, side = start, one
        if here >= least:
            if stack and stack[-1][0] == here:
                if stack[-1][2] != side:
                    stack[-1][2] = None
            else:
                stack.append([here, begin, side])


def _covered(strings: list[bytes], doc: np.ndarray, ver: np.ndarray, first: np.ndarray) -> list[tuple]:
    """Ranges (doc, ver, first, last) of strings in maximal repeats whose smallest doc_id is another."""
    number, offset, common, left = suffix_array(strings)
    d = doc[number]
    # Stretches without a common prefix of LENGTH, or within one document, hold nothing to remove.
    edge = np.flatnonzero(np.r_[True, common[1:] < LENGTH])
    several = np.minimum.reduceat(d, edge) < np.maximum.reduceat(d, edge)
    ends = np.r_[edge[1:], len(d)]
    out = []
    for a, z in zip(edge[several].tolist(), ends[several].tolist()):
        for length, b, e in maximal_repeats(common[a:z], left[a:z]):
            own = d[a + b : a + e]
            later = a + b + np.flatnonzero(own > own.min())
            if len(later):
                k = number[later]
                p = first[k] + offset[later]
                out.append((doc[k], ver[k], p, p + length - LENGTH))
    return out


def _scan_suffixes(t: pa.Table) -> pa.Table:
    """Per bucket: suffix arrays of its contexts, and the ranges that their maximal repeats cover."""
    out, keys, strings, docs, vers, firsts = _passed(t)[:1], [], [], [], [], []
    for r in t.to_pylist():
        if r["kind"] == COVER:
            continue
        at = 0
        for n in r["sizes"]:
            strings.append(r["bytes"][at : at + n])
            at += n
        keys.append(np.frombuffer(r["keys"], np.uint32))
        docs.append(_unplanes(r["doc"], np.int64))
        vers.append(_unplanes(r["ver"], np.uint32))
        firsts.append(_unplanes(r["first"], np.uint32).astype(np.int64))
    if strings:
        key, doc, ver, first = (np.concatenate(x) for x in (keys, docs, vers, firsts))
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        # Anchors are taken together up to TOGETHER contexts.
        cuts = [0]
        for a, z in zip(new.tolist(), [*new[1:].tolist(), len(by)]):
            if z - cuts[-1] > TOGETHER and a > cuts[-1]:
                cuts.append(a)
        found = []
        for a, z in zip(cuts, [*cuts[1:], len(by)]):
            i = by[a:z]
            found += _covered([strings[x] for x in i.tolist()], doc[i], ver[i], first[i])
        if found:
            out.append(_flat(COVER, False, None, *_merged(*(np.concatenate(x) for x in zip(*found)))))
    return pa.concat_tables(out)


# ---------------------------------------------------------------- step 4


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, spans, digest = [], [], [], []
        for raw, data in zip(_raws(batch), batch.column(2)):
            kept, at, cut, n = hashlib.sha256(), 0, 0, 0
            if data.as_py() is not None:
                r = np.frombuffer(data.as_py(), _RANGE)
                stop = -1
                for a, z in r[r["ver"] == _version(raw)][["first", "last"]].tolist():
                    z += LENGTH
                    if a > stop:
                        n += 1
                    kept.update(raw[at:a])  # nothing where ranges of strings overlap in bytes
                    cut += z - max(a, at)
                    at = stop = z
            kept.update(raw[at:])
            size.append(len(raw))
            removed.append(cut)
            spans.append(n)
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_ranges(docs: DataFrame, many_in_batch: int = MANY_IN_BATCH, many: int = MANY, block: int = BLOCK) -> DataFrame:
    """``doc_id, data``: merged ranges of repeated strings (records ``_RANGE``) of each document that has any."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * slices(docs.sparkSession), size // BUCKET_TEXT)

    def by_doc(rows: DataFrame, kind: int) -> DataFrame:
        own = rows.where(F.col("kind").isin(kind, ECHO) if kind == COVER else F.col("kind") == kind).withColumn("_b", F.pmod(F.xxhash64("doc"), F.lit(buckets)))
        return own.groupBy("_b").applyInArrow(_per_doc(kind), "doc_id long, data binary")

    packed = docs.mapInArrow(_find_anchors(buckets, many_in_batch, block), PACKED)
    found = stage(packed.groupBy("bucket").applyInArrow(_resolve(many), FLAT), "repeats-classes", free=True)
    asked = stage(by_doc(found, ASK), "repeats-asked", free=True)
    # Questions are many wherever texts repeat, so they are always joined by shuffle.
    contexts = _beside(docs, asked, _fetch(buckets), CONTEXTS, 0)
    more = stage(contexts.groupBy("bucket").applyInArrow(_scan_suffixes, FLAT), "repeats-suffixes", free=True)
    discard(asked)
    ranges = stage(by_doc(found.unionByName(more), COVER), "repeats-ranges", free=True)
    discard(found, more)
    return ranges


def remove_repeats(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, **limits: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = repeated_ranges(docs, **limits)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _beside(docs, ranges, _remove, schema, broadcast_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
