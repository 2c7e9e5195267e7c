"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups (equal texts) are ordered by digest.  The smallest feasible shard
capacity is searched over the prefix sums of their sizes; a capacity is tested
greedily (fill a shard up to the last group that fits, cut, go on).  Sizes obey
law ``bytes``: with no group larger than the mean shard, no shard exceeds the
mean by more than the largest group.

At scale: documents are reduced to digests and sizes before the first shuffle;
prefix sums are taken per digest bucket and bucket totals (at most ``BUCKETS``
rows) are chained on top; each search round tests ``PROBES`` capacities in one
aggregate per cut, and only prefix sums between the cuts of the capacities that
bracket the answer stay in play.  Once no more than ``FINISH_ROWS`` of them are
left, they are searched on the driver.  Rows of a group are numbered in
``SALTS`` parts, so a hot text is spread over tasks.

Defined results: a null text has no bytes, size 1, CRC 0, and null texts form a
group of their own; empty texts are another group; repeated rows each get a
slot; an empty table gives no rows; with fewer groups than shards some shards
stay empty; a group larger than the mean is never split; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

SHARDS = 8
BUCKETS = 4096
SALTS = 64
PROBES = 16
FINISH_ROWS = 50_000


def _greedy(last_fit, capacity: int, shards: int) -> list[int]:
    """Cut positions (prefix sums) of a greedy filling."""
    cuts, at = [], 0
    for _ in range(shards):
        at = last_fit(at + capacity)
        cuts.append(at)
    return cuts


def minimax_cuts(sums: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Prefix sums at which the smallest feasible capacity cuts; the last is ``total``.

    ``sums(p long)`` holds the distinct prefix sums of the ordered group sizes.
    """
    if not total:
        return [0] * shards
    low = max(-(-total // shards), largest)
    high = min(total, -(-total // shards) + largest)
    bounds = [(0, total)] * shards
    while True:
        near = sums.where(reduce(or_, [F.col("p").between(a, b) for a, b in dict.fromkeys(bounds)]))
        if near.limit(FINISH_ROWS + 1).count() <= FINISH_ROWS:
            points = sorted(r[0] for r in near.collect())

            def fit(x: int) -> int:
                i = bisect_right(points, x)
                return points[i - 1] if i else 0

            while low < high:
                mid = (low + high) // 2
                if _greedy(fit, mid, shards)[-1] >= total:
                    high = mid
                else:
                    low = mid + 1
            return _greedy(fit, low, shards)
        if low == high:
            at, cuts = 0, []
            for _ in range(shards):
                at = near.where(F.col("p") <= at + low).agg(F.max("p")).first()[0] or at
                cuts.append(at)
            return cuts
        probes = sorted({low + (high - low) * i // PROBES for i in range(PROBES + 1)})
        ends = dict.fromkeys(probes, 0)
        found: dict[int, list[int]] = {c: [] for c in probes}
        for _ in range(shards):
            row = near.agg(*[F.max(F.when(F.col("p") <= ends[c] + c, F.col("p"))).alias(f"c{i}") for i, c in enumerate(probes)]).first()
            for i, c in enumerate(probes):
                ends[c] = max(ends[c], row[i] or 0)
                found[c].append(ends[c])
        high = next(c for c in probes if found[c][-1] >= total)
        fails = [c for c in probes if c < high]
        # A larger capacity never cuts earlier, so the answer's cuts lie between these.
        lows = found[fails[-1]] if fails else found[high]
        bounds = list(zip(lows, found[high]))
        low = fails[-1] + 1 if fails else high


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs(doc_id, text)``."""
    raw = F.encode("text", "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(raw, 256), F.lit("null")).alias("h"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    parts = stage(rows.groupBy("h", "salt").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-parts")
    bucket = F.pmod(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), F.lit(BUCKETS))
    groups = parts.groupBy("h").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    groups = groups.withColumn("bucket", F.coalesce(bucket, F.lit(0)))
    totals = groups.groupBy("bucket").agg(F.sum("size").alias("bs"), F.sum("n").alias("bn"))
    # At most BUCKETS rows, whatever the input: the one task and the broadcast are bounded.
    chain = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "bucket",
        F.coalesce(F.sum("bs").over(chain), F.lit(0)).alias("base"),
        F.coalesce(F.sum("bn").over(chain), F.lit(0)).alias("base_n"),
    )
    inside = Window.partitionBy("bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    sums = groups.join(F.broadcast(base), "bucket").select(
        "h",
        "size",
        (F.col("base") + F.sum("size").over(inside)).alias("p"),
        (F.col("base_n") + F.sum("n").over(inside) - F.col("n")).alias("before"),
    )
    sums = stage(sums, "shard-sums")
    whole = sums.agg(F.max("p").alias("total"), F.max("size").alias("largest")).first()
    cuts = minimax_cuts(sums.select("p"), whole["total"] or 0, whole["largest"] or 0, shards)
    # A group belongs to the first shard whose cut reaches its end.
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[:-1]]), lambda c: c < F.col("p")))
    placed = sums.select("h", number.alias("shard"), "before")
    first = placed.groupBy("shard").agg(F.min("before").alias("first"))  # one row a shard
    placed = placed.join(F.broadcast(first), "shard").select("h", "shard", (F.col("before") - F.col("first")).alias("start"))
    in_group = Window.partitionBy("h").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.withColumn("earlier", F.coalesce(F.sum("n").over(in_group), F.lit(0)))
        .join(placed, "h")
        .select("h", "salt", "shard", (F.col("start") + F.col("earlier")).alias("start"))
    )
    in_part = Window.partitionBy("h", "salt").orderBy("doc_id")
    return rows.join(starts, ["h", "salt"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.row_number().over(in_part) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
