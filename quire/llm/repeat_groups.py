"""Maximal repeat groups with all their occurrences, over whole texts.

``op9_repeats`` asks which bytes repeat; this asks what repeats where: every string
of at least ``LENGTH`` bytes that occurs twice or more and grows neither to the left
nor to the right without losing an occurrence, with each place it occurs at.

1. *Beginnings.*  A maximal repeat begins where the byte before it differs between
   its occurrences.  Strings of ``LENGTH`` bytes inside a context that is the same
   wherever its anchor occurs cannot begin one, so only the first string of such
   contexts, and the strings of anchors with several contexts, may begin one; of
   these an aggregation keeps the strings that follow different bytes.
2. *Ladder.*  Each suffix that is left gets hashes of its first 50, 100, 200, ... bytes.  Suffixes
   with one hash are a node of that level; nodes that neither branch before the next
   level nor follow different bytes are left out by an aggregation.
3. *Scan.*  Suffixes of a node that agree up to the next level are one leaf, with
   one piece of text.  Spark sorts the leaves of every node; a stack scan over common
   prefixes streams through them and yields the intervals whose left neighbours
   differ.  It holds the stack and no group.
   Nodes with more than ``MANY`` leaves would make one long task; theirs are found by
   aggregating all prefixes of the leaves instead, which combines before it shuffles.
4. *Occurrences.*  Intervals list their leaves, leaves join their suffixes.

Defined results: null texts and texts below 50 bytes have no groups; equal rows of
one doc_id count once, different texts of one doc_id are told apart by ``version``;
ends of texts differ from every byte and from each other; an empty table gives no
rows; other columns are ignored.  Occurrences of one group may overlap.  A text that
repeats a line n times holds n nested groups, and as every one is listed whole their
rows grow with the square of n.  Prefixes are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage
from .op9_repeats import BLOCK, LENGTH, PORTION, anchors
from .shingles import mix

#: Leaves of a node that one task sorts; the prefixes of larger nodes are aggregated.
MANY = 20_000
#: The byte before a text's first one.
START = -1

_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_CONTEXT = "doc_id long, version long, first long, strings int, before int, anchor long, context long"
_SUFFIX = "doc_id long, version long, first long, before int, ladder array<long>"
_LEAF = "level int, node long, leaf long, ends boolean, n long, low int, high int, piece binary"
_FOUND = "level int, node long, leaf long, at long, length long, begin long, end long"


def ladder(raw: bytes, most: int = 64, length: int = LENGTH) -> list[np.ndarray]:
    """Hashes of the first ``length``, 2 * ``length``, ... bytes of every suffix that has so many; at most ``most`` of them."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < length:
        return []
    with np.errstate(over="ignore"):
        # Any length is two windows of a power of two that overlap.
        h, width = mix(data.astype(np.uint64) + _TURN[0]), 1
        while 2 * width <= length:
            h = mix(h[: len(h) - width] * _TURN[0] + h[width:])
            width *= 2
        rest = length - width
        out = [mix(h[: len(h) - rest] * _TURN[1] + h[rest:])]
        size = length
        while 2 * size <= len(data) and len(out) < most:
            out.append(mix(out[-1][: len(out[-1]) - size] * _TURN[0] + out[-1][size:]))
            size *= 2
    return [x.view(np.int64) for x in out]


def _raw(t) -> bytes:
    return t.as_py().encode("utf-8", "surrogatepass")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "version", "first", "strings", "before", "anchor", "context"]

    def rows(ids, versions, raws):
        text, first, span, fp, cls = anchors(raws, BLOCK)
        before = [raws[t][p - 1] if p else START for t, p in zip(text.tolist(), first.tolist())]
        columns = [ids[text], versions[text], first, (span + 1).astype(np.int32), np.array(before, np.int32), fp.view(np.int64), cls.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for b in batches:
        ids, versions = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        raws, begin, size = [], 0, 0
        for i, t in enumerate(b.column(2)):
            raws.append(_raw(t))
            size += len(raws[-1])
            if size >= PORTION or i + 1 == b.num_rows:
                yield rows(ids[begin : i + 1], versions[begin : i + 1], raws)
                raws, begin, size = [], i + 1, 0


def _suffixes(most: int):
    """Suffixes that a document was asked for, with their ladders or the first steps of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, version, t, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                raw = _raw(t)
                steps = ladder(raw, most)
                places = np.unique(np.concatenate([np.arange(q["first"], q["first"] + q["strings"]) for q in asked.as_py()]))
                for at in range(0, len(places), 10_000):
                    p = places[at : at + 10_000]
                    high = [int(np.searchsorted(p, len(s))) for s in steps]
                    rungs = np.zeros((len(p), len(steps)), np.int64)
                    for i, (s, n) in enumerate(zip(steps, high)):
                        rungs[:n, i] = s[p[:n]]
                    fits = sum((np.arange(len(p)) < n).astype(np.int32) for n in high)
                    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(fits)].astype(np.int32), rungs[np.arange(len(steps)) < fits[:, None]])
                    before = np.array([raw[x - 1] if x else START for x in p.tolist()], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), doc)), pa.array(np.full(len(p), version)), pa.array(p), pa.array(before), lists],
                        names=["doc_id", "version", "first", "before", "ladder"],
                    )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves with their text between a level and the next."""
    schema = pa.schema([
        ("level", pa.int32()), ("node", pa.int64()), ("leaf", pa.int64()), ("ends", pa.bool_()), ("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("piece", pa.binary())
    ])
    for b in batches:
        for t, asked in zip(b.column(2), b.column(3)):
            raw, out, size = _raw(t), [], 0
            for q in asked.as_py():
                deep = LENGTH << q["level"]
                out.append({n: q[n] for n in schema.names[:-1]} | {"piece": raw[q["first"] + deep : q["first"] + 2 * deep]})
                size += len(out[-1]["piece"])
                if size > BLOCK:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(leaves: Iterable[tuple[bytes, int | None]]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, begin, end) of the maximal repeats among sorted leaves ``(piece, byte before)``.

    The byte before is None where the suffixes of a leaf differ in it.  An interval
    closes where the common prefix falls below its own.
    """
    # Entries: common prefix, begin, the byte before of all of it or None.
    stack: list[list] = []
    last: tuple[bytes, int | None] | None = None
    i = 0

    def close(here: int):
        begin, side = i - 1, last[1]
        while stack and stack[-1][0] > here:
            length, begin, one = stack.pop()
            side = one if one == side else None
            if side is None:
                yield length, begin, i
        if here >= 0:
            if stack and stack[-1][0] == here:
                if stack[-1][2] != side:
                    stack[-1][2] = None
            else:
                stack.append([here, begin, side])

    for leaf in leaves:
        if last is not None:
            yield from close(common_prefix(last[0], leaf[0]))
        last, i = leaf, i + 1
    if last is not None:
        yield from close(-1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves with their numbers, and intervals, of nodes that follow one another in order."""
    from itertools import groupby

    schema = pa.schema([("level", pa.int32()), *((n, pa.int64()) for n in ("node", "leaf", "at", "length", "begin", "end"))])
    out: list[tuple] = []

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def numbered(level: int, node: int, own):
        for at, (_, _, leaf, _, n, low, high, piece) in enumerate(own):
            out.append((level, node, leaf, at, None, None, None))
            # A lone beginning of a text has a neighbour like no other: below START, by number.
            yield piece, (START - 1 - at if n == 1 else None) if low == START else low if low == high else None

    def batch():
        done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return done

    for (level, node), own in groupby(rows(), lambda r: r[:2]):
        for common, begin, end in intervals(numbered(level, node, own)):
            out.append((level, node, None, None, (LENGTH << level) + common, begin, end))
            if len(out) > 10_000:
                yield batch()
        if len(out) > 10_000:
            yield batch()
    if out:
        yield batch()


def _diverse(n: str, low: str, high: str) -> Column:
    return (F.col(n) > 1) & ((F.col(low) < F.col(high)) | (F.col(low) == START))


def _beside(texts: DataFrame, asked: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over every document that was asked, with its questions."""
    by_doc = asked.groupBy("doc_id", "version").agg(F.collect_list("q").alias("asked"))
    return texts.join(by_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "asked").mapInArrow(work, schema)


def _by_prefixes(leaves: DataFrame) -> DataFrame:
    """Groups of nodes with very many leaves: every prefix of their pieces that branches, by aggregation."""
    size = F.octet_length("piece")
    each = leaves.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("ends"), size).otherwise(size - 1))).alias("d"))
    each = each.select(
        "level", "node", "leaf", "n", "low", "high", "d", F.xxhash64(F.expr("substring(piece, 1, d)")).alias("prefix"), F.when(F.col("d") < size, F.hex(F.expr("substring(piece, d + 1, 1)"))).alias("after"),
    )
    key = ["level", "node", "d", "prefix"]
    nodes = each.groupBy(*key).agg(
        F.sum("n").alias("total"), F.min("low").alias("lowest"), F.max("high").alias("highest"), F.min("after").alias("a"), F.max("after").alias("z"), F.count("after").alias("on"), F.count("*").alias("all")
    )
    nodes = nodes.where(_diverse("total", "lowest", "highest") & ((F.col("a") < F.col("z")) | (F.col("on") < F.col("all")))).select(*key)
    return each.join(nodes, key).select("level", "node", "leaf", (F.expr(f"shiftleft({LENGTH}L, level)") + F.col("d")).alias("length"), F.xxhash64("level", "node", "d", "prefix").alias("group"))


def repeat_groups(docs: DataFrame, many: int = MANY) -> DataFrame:
    """``group, length, doc_id, version, first`` for each occurrence of each maximal repeat in ``docs(doc_id, text)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").where(F.octet_length("text") >= LENGTH)
    found = stage(texts.mapInArrow(_contexts, _CONTEXT), "groups-contexts")
    texts = texts.dropDuplicates(["doc_id", "version"])

    # Tables of names are written, so that the planner knows their size and broadcasts small ones only.
    shared = stage(found.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("before").alias("low"), F.max("before").alias("high"), (F.min("context") < F.max("context")).alias("several")
    ).where(_diverse("n", "low", "high") | ((F.col("n") > 1) & F.col("several"))).select("anchor", "several"), "groups-anchors")
    asked = found.join(shared, "anchor").select("doc_id", "version", F.struct("first", F.when(F.col("several"), F.col("strings")).otherwise(1).alias("strings")).alias("q"))
    starts = stage(_beside(texts, asked, _suffixes(1), _SUFFIX).withColumn("head", F.col("ladder")[0]).drop("ladder"), "groups-starts")
    discard(found, shared)
    heads = starts.groupBy("head").agg(F.count("*").alias("n"), F.min("before").alias("low"), F.max("before").alias("high")).where(_diverse("n", "low", "high"))
    heads = stage(heads.select("head"), "groups-heads")
    asked = starts.join(heads, "head", "left_semi").select("doc_id", "version", F.struct("first", F.lit(1).alias("strings")).alias("q"))
    suffixes = stage(_beside(texts, asked, _suffixes(64), _SUFFIX), "groups-suffixes")
    discard(starts, heads)

    rungs = suffixes.select("doc_id", "version", "first", "before", "ladder", F.posexplode("ladder").alias("level", "node"))
    after = F.expr("try_element_at(ladder, level + 2)")
    rungs = rungs.select("doc_id", "version", "first", "before", "level", "node", F.coalesce(after, F.xxhash64("doc_id", "version", "first")).alias("leaf"), after.isNull().alias("ends"))
    key = ["level", "node"]
    nodes = rungs.groupBy(*key).agg(F.count("*").alias("n"), F.min("before").alias("low"), F.max("before").alias("high"), F.min("leaf").alias("a"), F.max("leaf").alias("z"))
    nodes = stage(nodes.where(_diverse("n", "low", "high") & (F.col("a") < F.col("z"))).select(*key), "groups-nodes")
    rungs = stage(rungs.join(nodes, key), "groups-rungs")
    discard(suffixes, nodes)

    leaves = rungs.groupBy(*key, "leaf", "ends").agg(
        F.count("*").alias("n"), F.min("before").alias("low"), F.max("before").alias("high"), F.min(F.struct("doc_id", "version", "first")).alias("one")
    )
    asked = leaves.select("one.doc_id", "one.version", F.struct(*key, "leaf", "ends", "n", "low", "high", "one.first").alias("q"))
    leaves = stage(_beside(texts, asked, _pieces, _LEAF), "groups-leaves")
    hot = leaves.groupBy(*key).count().where(F.col("count") > many).select(*key)
    ordered = leaves.join(hot, key, "left_anti").select(*leaves.columns).repartition(*key).sortWithinPartitions(*key, "piece", "leaf")
    scanned = stage(ordered.mapInArrow(_scan, _FOUND), "groups-scanned")
    spans = scanned.where("length is not null").select(*key, "length", F.xxhash64(*key, "length", "begin").alias("group"), F.explode(F.sequence("begin", F.col("end") - 1)).alias("at"))
    of_leaves = spans.join(scanned.where("length is null").select(*key, "at", "leaf"), [*key, "at"]).select(*key, "leaf", "length", "group")
    of_leaves = of_leaves.unionByName(_by_prefixes(leaves.join(hot, key, "left_semi")))
    return of_leaves.join(rungs, [*key, "leaf"]).select("group", "length", "doc_id", "version", "first")
