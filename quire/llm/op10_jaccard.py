"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Two sets link when 100 * |intersection| >= 75 * |union|.  Under any fixed order
of all shingles, linked sets share at least ``k`` shingles among their first
``n - ceil(0.75 n) + k``, here with ``k = n / 8``; frequent shingles are put last
in that order, so that common lines and passages seldom name a tile.  A set that
has fewer than ``k`` such shingles in common with all others together, as when it
only quotes a passage, links nothing and is dropped before any array travels.  A tile is such a shingle within a
size band; linked sets have sizes in the ratio of 4/3 at most, so they meet in
the tile of their common or adjoining band.

Every tile is led by its smallest name, and tiles of one leader are one group, so a
set travels to a few groups instead of to dozens of tiles, and linked sets still
meet in one.  As they share ``k`` shingles, a set may leave groups, those that hold
the fewest of its shingles first, until less than half of ``k`` is given up: two
sets then give up less than ``k`` together.  A group is cut into blocks of bounded
bytes, each with the leader.  Within a block, in its own task, bit counts of hashed
bitmaps bound the overlaps from above; sets with a near partner are fetched whole
and held against those not yet in their component by intersecting sorted arrays.
What leaves a task is a spanning forest, never the pairs.  Groups of one block are
then done.  In larger ones, the sets outside of the group's main component are few;
they are held against the other blocks, outliers of a block against members of a block.

At scale: equal sets count once, whatever the number of copies; prefixes travel
packed, to as many buckets as their bytes ask for, those of a set with very many
copies once; a frequent shingle is known to be a tile, so its rows go to any bucket
and no bucket holds them all; tables by tile and name are plain aggregates and joins.  The list of frequent
shingles is at most 2,000 times the mean set size, whatever the number of
documents; lists of names are broadcast behind a count, beyond that joined by a shuffle.

Defined results: null, empty and blank texts have no shingles and are components
of their own; equal sets link; rows that repeat a doc_id and text get the same
result; a doc_id with several texts is one row each, and they link like others; a null
doc_id is a row with its n_shingles whose component is the smallest doc_id linked
to it, or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, slices, stage, table
from .components import connected
from .shingles import mix, portions, shingle_sets, signature

PERCENT = 75
#: A shingle in more than one of so many documents goes to the end of the order.
FREQUENT = 2000
#: Just over 4/3: sizes in a ratio of up to 4/3 are at most one band apart, whatever the rounding.
BAND = 1.34
#: Rows up to which a list of names or ids (32 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000
#: Prefixes are longer by one eighth of the set, and must share that much.
SHARED = 8
#: Packed bytes of a bucket of prefixes, of a prefix's element in it, and the least number of buckets.
BUCKET_BYTES, PACKED, BUCKETS = 16 << 20, 18, 64
#: Sets and elements of a block.
BLOCK_SETS, BLOCK_ELEMENTS = 256, 1 << 20


def linked(a: int, b: int, both: int) -> bool:
    return 100 * both >= PERCENT * (a + b - both)


def least_shared(n: int) -> int:
    """Shingles that linked sets of at least ``n`` elements share among their prefixes."""
    return max(1, n // SHARED)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + least_shared(n)


def band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / math.log(BAND)).astype(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set: two bits an element, rounded up to a power of two."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    out = np.zeros(width, np.uint8)
    out[(s >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), 0)


class Bitmaps:
    """Sizes and bitmaps of a block's sets; two are compared in the narrower one's width."""

    def __init__(self, n: list[int], bits: list[np.ndarray]):
        self.n, self.words = np.array(n, np.int64), np.array([len(b) for b in bits])
        self.levels = {}
        for w in np.unique(self.words).tolist():
            self.levels[w] = np.zeros((len(bits), w), np.uint64)
            for i in np.flatnonzero(self.words >= w).tolist():
                self.levels[w][i] = fold(bits[i], w)

    def bounds(self, i: int, others: np.ndarray) -> np.ndarray:
        """Upper bounds of overlaps: each bit that differs takes an element that only one of the two sets has."""
        differ = np.zeros(len(others), np.int64)
        for w, rows in self.levels.items():
            if w <= self.words[i]:
                at = np.flatnonzero(np.minimum(self.words[others], self.words[i]) == w)
                differ[at] = np.bitwise_count(rows[others[at]] ^ rows[i]).sum(1, dtype=np.int64)
        return (self.n[i] + self.n[others] - differ) // 2

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the ``others`` (a mask) that sizes and bitmaps let link with set ``i``."""
        n = self.n
        near = np.flatnonzero(others & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])))
        return near[linked(n[i], n[near], self.bounds(i, near))]


# ---------------------------------------------------------------- pass 1: sizes, names, frequent shingles


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document's id, set size, set name and bitmap.  Kind 1: a shingle frequent in this batch and its count."""
    for batch in portions(batches, 1):
        ids = batch.column(0).to_pylist()
        n, names, bits, own, seen = [], [], [], [], set()
        for s in shingle_sets(batch.column(1).to_pylist()):
            n.append(len(s))
            names.append(signature(s) if len(s) else None)
            bits.append(bitmap(s).tobytes() if len(s) else None)
            if len(s) and names[-1] not in seen:
                seen.add(names[-1])
                own.append(s)
        h, c = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = c >= max(4, len(own) // 500)
        h, c = h[often].view(np.int64), c[often]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.zeros(len(ids), np.int8), np.ones(len(h), np.int8)]),
                pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(len(h), pa.int64())]),
                pa.concat_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64())]),
                pa.concat_arrays([pa.array(names, pa.int64()), pa.array(h, pa.int64())]),
                pa.concat_arrays([pa.array(bits, pa.binary()), pa.nulls(len(h), pa.binary())]),
            ],
            names=["kind", "doc_id", "n", "name", "bits"],
        )


# ---------------------------------------------------------------- pass 2: prefixes to tiles


class Order:
    """The order of shingles: the rest by hash, then frequent ones by count and hash; documents that stand for much-copied sets."""

    def __init__(self, frequent: np.ndarray, copied: dict[int, int] | None = None):
        self.copied = copied or {}
        # ``frequent`` comes in that order; its ranks are looked up by hash.
        by_hash = np.argsort(frequent)
        self.hashes, self.ranks = frequent[by_hash], by_hash.astype(np.int64)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first elements of ``s``, and the ranks of frequent ones where these are not enough."""
        p = prefix_length(len(s))
        if not len(self.hashes):
            return s[:p], self.ranks
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        often = self.hashes[at] == s
        rare = s[~often][:p]
        return rare, np.sort(self.ranks[at[often]])[: p - len(rare)]


def _prefixes(order, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = order.value
        for batch in portions(batches, 1):
            seen, tokens, often, names, sizes = set(), [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist())):
                if not len(s) or (name := signature(s)) in seen or rule.copied.get(name, i) != i:
                    continue
                seen.add(name)
                rare, late = rule.prefix(s)
                # Six bytes tell rare shingles of a bucket apart well enough: a false tile only costs a verification.
                tokens += [rare, late.astype(np.uint64) << np.uint64(16)]
                often += [np.zeros(len(rare), bool), np.ones(len(late), bool)]
                names.append(np.full(len(rare) + len(late), name, np.int64))
                sizes.append(np.full(len(rare) + len(late), len(s), np.int32))
            if not tokens:
                continue
            t, o, m, z = np.concatenate(tokens), np.concatenate(often), np.concatenate(names), np.concatenate(sizes)
            # A frequent one needs no partner in its bucket, so its rows are dealt by name; their sizes are told as negative.
            b = (np.where(o, mix(m.view(np.uint64)), t) % np.uint64(buckets)).astype(np.int64)
            z = np.where(o, -z, z)
            by = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[by], np.arange(buckets + 1))
            rows = [(k, by[cuts[k] : cuts[k + 1]]) for k in np.unique(b).tolist()]
            short = (t >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in rows], pa.int32()),
                    pa.array([short[i].tobytes() for _, i in rows], pa.binary()),
                    pa.array([m[i].tobytes() for _, i in rows], pa.binary()),
                    pa.array([z[i].tobytes() for _, i in rows], pa.binary()),
                ],
                names=["bucket", "tokens", "names", "sizes"],
            )

    return run


FOUND = "tile long, lead long, name long, n long, k long, w long"


def _tiles(rows: pa.Table) -> pa.Table:
    """Members of the groups that tiles of a bucket form: ``lead, name, n``, and ``w``, how many shingles of the set the group holds here.

    ``k`` counts each of the set's shared shingles in one of its groups only.  Frequent shingles
    have a ``tile`` instead of a lead.
    """
    def gather(column: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in rows.column(column)), kind)

    def starts(*keys: np.ndarray) -> np.ndarray:
        if not len(keys[0]):
            return np.zeros(0, int)
        return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])

    with np.errstate(over="ignore"):
        six = gather("tokens", np.uint8).reshape(-1, 6)
        t = np.zeros((len(six), 8), np.uint8)
        t[:, :6] = six
        t = t.view(np.uint64).ravel()
        names, n = gather("names", np.int64), gather("sizes", np.int32)
        often = n < 0
        hot, hot_names, hot_n = t[often], names[often], -n[often]
        t, names, n = t[~often], names[~often], n[~often]
        by = np.argsort(t, kind="stable")
        t, names, n = t[by], names[by], n[by]
        same = t[1:] == t[:-1]
        shared = np.r_[same, False] | np.r_[False, same] if len(t) else np.zeros(0, bool)  # a shingle of one set links nothing
        t, names, n = t[shared], names[shared], n[shared]
        by = np.lexsort((names, t))
        by = by[starts(t[by], names[by])]
        t, names, n = t[by], names[by], n[by]
        b = band(n).astype(np.uint64)
        tile, name, source = mix(np.r_[t * np.uint64(256) + b, t * np.uint64(256) + b + np.uint64(1)]), np.r_[names, names], np.r_[np.arange(len(t)), np.arange(len(t))]
        by = np.lexsort((name, tile))
        tile, name, source = tile[by], name[by], source[by]
        at = starts(tile)
        counts = np.diff(np.r_[at, len(tile)])
        several = np.repeat(counts > 1, counts)
        lead, name, source = np.repeat(name[at], counts)[several], name[several], source[several]
        # A shingle counts once for a set in each group, in ``k`` for one of its groups.
        by = np.lexsort((lead, source))
        by = by[starts(source[by], lead[by])]
        lead, name, source = lead[by], name[by], source[by]
        first = np.zeros(len(source), np.int64)
        first[starts(source)] = 1
        by = np.lexsort((name, lead))
        lead, name, first, size = lead[by], name[by], first[by], n[source[by]]
        at = starts(lead, name)
        k, w = np.add.reduceat(first, at) if len(at) else first, np.diff(np.r_[at, len(lead)])
        # Every frequent shingle is a tile, named by its rank alone, in all buckets alike.
        h = band(hot_n).astype(np.uint64)
        hot_tile = mix(~(np.r_[hot, hot] * np.uint64(256) + np.r_[h, h + np.uint64(1)])).view(np.int64)
        ones = np.ones(len(hot), np.int64)
    return pa.table(
        {
            "tile": pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(hot_tile)]),
            "lead": pa.concat_arrays([pa.array(lead[at]), pa.nulls(len(hot_tile), pa.int64())]),
            "name": pa.array(np.r_[name[at], hot_names, hot_names]),
            "n": pa.array(np.r_[size[at], hot_n, hot_n].astype(np.int64)),
            "k": pa.array(np.r_[k, ones, 0 * ones]),
            "w": pa.array(np.r_[w, ones, ones].astype(np.int64)),
        }
    )


# ---------------------------------------------------------------- blocks


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 0):
        sets = {signature(s): s for s in shingle_sets(batch.column(0).to_pylist()) if len(s)}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sets), pa.int64()), pa.array(list(map(len, sets.values())), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["name", "n", "blob"]
        )


def near_block(bits: Bitmaps, label: np.ndarray, among: list[int]) -> np.ndarray:
    """Mask of the sets that may link with one of another component, ``among`` on one side at least."""
    out, inside = np.zeros(len(label), bool), np.zeros(len(label), bool)
    inside[among] = True
    for i in among:
        # One near set is enough for one that is known as near; the others may still need it.
        rest = (label != label[i]) & ~(out & out[i] & inside)
        near = bits.near(i, rest) if rest.any() else []
        if len(near):
            out[near] = True
            out[i] = True
    return out


def link_block(sets: list[np.ndarray], label: np.ndarray, among: list[int]) -> list[tuple[int, int]]:
    """Links that join the components of a block; ``label`` holds those known so far and is changed.

    Each set of ``among`` is held against all that are not yet in its component.
    Where all are among, those that have joined the first one need no look: the rest will be held against them.
    """
    all_look = len(among) == len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    bits = Bitmaps(n, [bitmap(s) for s in sets])
    out, looked, main = [], np.zeros(len(sets), bool), None
    for i in among:
        if all_look and main is not None and label[i] == label[main]:
            continue
        near = bits.near(i, (label != label[i]) & ~looked)
        looked[i] = True
        main = i if main is None else main
        # In portions, so that most of a large component is joined before its other members are looked at.
        for part in np.array_split(near, -(-len(near) // 64)) if len(near) else []:
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            others = np.concatenate([sets[j] for j in part])
            at = np.minimum(np.searchsorted(sets[i], others), n[i] - 1)
            both = np.add.reduceat((sets[i][at] == others).astype(np.int64), np.r_[0, np.cumsum(n[part])[:-1]])
            for j in part[linked(n[i], n[part], both)].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


#: A set's use in a block.
USE = "lead long, block int, outlier boolean, root long, name long"


def _by_block(batches: Iterator[pa.RecordBatch], step, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``step`` for the rows of each block, which come as ``USE``, a size and a blob, sorted by (lead, block).

    Outliers are looked at, the leader first; the others are what they are held against.
    """
    def done(rows: dict) -> list[tuple]:
        names = sorted(rows, key=lambda m: (not rows[m][0], m != key[0], m))
        _, label = np.unique([rows[m][1] for m in names], return_inverse=True)
        return step(key, names, label, [i for i, m in enumerate(names) if rows[m][0]], [rows[m] for m in names])

    key, rows = None, {}
    for batch in batches:
        out = []
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for k, outlier, root, name, n, blob in zip(keys, *(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), batch.column(6)):
            if k != key:
                out += done(rows) if rows else []
                key, rows = k, {}
            rows[name] = (outlier or name in rows and rows[name][0], root, n, blob.as_py())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
    if rows and (out := done(rows)):
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The uses of sets whose bitmaps leave room for a link in their block."""
    def step(key, names, label, among, rows):
        near = near_block(Bitmaps([x[2] for x in rows], [np.frombuffer(x[3], np.uint64) for x in rows]), label, among)
        return [(*key, rows[i][0], rows[i][1], names[i]) for i in np.flatnonzero(near).tolist()]

    fields = [("lead", pa.int64()), ("block", pa.int32()), ("outlier", pa.bool_()), ("root", pa.int64()), ("name", pa.int64())]
    return _by_block(batches, step, pa.schema(fields))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links ``a, b`` of each block."""
    def step(key, names, label, among, rows):
        return [(names[i], names[j]) for i, j in link_block([np.frombuffer(x[3], np.uint64) for x in rows], label, among)]

    return _by_block(batches, step, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def in_blocks(rows: DataFrame, uses: DataFrame, step, schema: str) -> DataFrame:
    """``step`` over the blocks of ``uses``, with the blobs of ``rows(name, n, blob)``, which move once."""
    rows = rows.join(F.broadcast(uses) if small(uses) else uses, "name").select("lead", "block", "outlier", "root", "name", "n", "blob")
    return rows.repartition("lead", "block").sortWithinPartitions("lead", "block").mapInArrow(step, schema)


def block_links(docs: DataFrame, meta: DataFrame, classes: DataFrame, uses: DataFrame) -> DataFrame:
    """``a, b`` for ``uses`` (as ``USE``): links that join the components in each block, from bitmaps, then from arrays."""
    def once(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        return rows.dropDuplicates(["name"]) if wanted.where("twice").limit(1).count() else rows

    uses = stage(uses, "jaccard-uses")
    wanted = uses.select("name").distinct().join(classes.select("name", F.col("rep").alias("doc_id"), "twice"), "name")
    wanted = stage(wanted, "jaccard-wanted")
    first = F.broadcast(wanted) if small(wanted) else wanted
    told = meta.alias("m").join(first.alias("w"), (F.col("m.name") == F.col("w.name")) & F.col("m.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    near = stage(in_blocks(once(told.select("name", "n", F.col("bits").alias("blob")), wanted), uses, _near, USE), "jaccard-near")
    wanted = stage(wanted.join(near.select("name").distinct(), "name", "left_semi"), "jaccard-wanted")
    ids = wanted.select("doc_id").distinct()
    mine = docs.join(F.broadcast(ids) if small(ids) else ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    sets = once(mine.mapInArrow(_sets, "name long, n long, blob binary"), wanted)
    return stage(in_blocks(sets, near, _links, "a long, b long"), "jaccard-links")


# ---------------------------------------------------------------- the join


def groups_of(found: DataFrame) -> DataFrame:
    """``lead, name, n``: the groups in which a set has to be held against others, from ``found`` (as ``FOUND``)."""
    hot = found.where("tile is not null").drop("lead")
    leads = stage(hot.groupBy("tile").agg(F.min("name").alias("lead"), F.max("name").alias("hi")).where("lead <> hi").select("tile", "lead"), "jaccard-leads")
    all_ = found.where("tile is null").select("lead", "name", "n", "k", "w").union(hot.join(leads, "tile").select("lead", "name", "n", "k", "w"))
    members = all_.groupBy("lead", "name").agg(F.max("n").alias("n"), F.sum("k").alias("k"), F.sum("w").alias("w"))
    # A partner has at least 0.75 n elements, so this many shingles at least are shared with it.
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / SHARED))
    own = Window.partitionBy("name")
    given_up = F.sum("w").over(own.orderBy("w", "lead").rowsBetween(Window.unboundedPreceding, 0))
    members = members.withColumn("all", F.sum("k").over(own)).withColumn("given_up", given_up)
    members = members.where((F.col("all") >= least) & (F.col("given_up") > F.floor((least - 1) / 2)))
    return stage(members.select("lead", "name", "n"), "jaccard-groups")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = stage(docs.mapInArrow(_describe, "kind byte, doc_id long, n long, name long, bits binary"), "jaccard-told")
    meta = told.where("kind = 0")
    rows = meta.where("n > 0").groupBy("name", "doc_id").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    classes = rows.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows")).alias("first"), F.sum("rows").alias("copies"), F.max("n").alias("n"))
    classes = classes.select("name", "n", "copies", F.col("first.doc_id").alias("rep"), (F.col("first.rows") > 1).alias("twice"))
    classes = stage(classes, "jaccard-classes")

    total, elements = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    many = max(8, total // FREQUENT)
    frequent = told.where("kind = 1").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= many).orderBy("n", "name").select("name").toPandas()
    copied = {r.name: r.rep for r in classes.where((F.col("copies") >= many) & F.col("rep").isNotNull()).select("name", "rep").collect()}  # FREQUENT at most
    order = spark.sparkContext.broadcast(Order(frequent["name"].to_numpy(np.int64).view(np.uint64), copied))
    buckets = max(BUCKETS, slices(spark), elements * PACKED * 3 // 8 // BUCKET_BYTES)
    packed = docs.mapInArrow(_prefixes(order, buckets), "bucket int, tokens binary, names binary, sizes binary")
    found = stage(packed.groupBy("bucket").applyInArrow(_tiles, FOUND), "jaccard-found", free=True)
    groups = groups_of(found)
    discard(found)

    # All sets of a block against each other, the leader first.
    load = groups.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks"), F.count("*").alias("m"))
    placed = groups.join(load.where("m > 1").drop("m"), "lead")
    here = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = placed.where("name <> lead").select("lead", here.alias("block"), "name")
    leads = placed.where("name = lead").select("lead", everywhere.alias("block"), "name")
    uses = members.union(leads).select("lead", "block", F.lit(True).alias("outlier"), F.col("name").alias("root"), "name")
    links = block_links(docs, meta, classes, uses)
    roots = connected(links).withColumnRenamed("node", "name")

    # Groups of several blocks: what lies outside of the main component, against the others.
    large = placed.where("blocks > 1").select("lead", "name", "n").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    large = stage(large, "jaccard-large")
    most = large.groupBy("lead", "root").agg(F.count("*").alias("m")).groupBy("lead").agg(F.max(F.struct("m", "root")).alias("top")).select("lead", F.col("top.root").alias("main"))
    large = large.join(most, "lead").withColumn("outlier", F.col("root") != F.col("main"))
    cut = lambda rows: F.greatest(F.ceil(F.count(rows) / BLOCK_SETS), F.ceil(F.sum(F.when(rows.isNotNull(), F.col("n"))) / BLOCK_ELEMENTS)).cast("int")
    load = stage(large.groupBy("lead").agg(cut(F.when(F.col("outlier"), F.lit(1))).alias("xs"), cut(F.col("name")).alias("ys")).where("xs > 0"), "jaccard-load")
    if load.limit(1).count():
        held = large.join(load, "lead")
        of = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = held.where("outlier").select("lead", of("xs").alias("x"), each("ys").alias("y"), "ys", "outlier", "root", "name")
        y = held.select("lead", each("xs").alias("x"), of("ys").alias("y"), "ys", F.lit(False).alias("outlier"), "root", "name")
        uses = x.union(y).select("lead", (F.col("x") * F.col("ys") + F.col("y")).alias("block"), "outlier", "root", "name")
        more = block_links(docs, meta, classes, uses)
        # Components of components.
        ends = more
        for side in ("a", "b"):
            ends = ends.join(roots.select(F.col("name").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
        over = connected(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        nodes = roots.union(over.select("node", "node")).distinct()
        roots = nodes.join(over.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("name", F.coalesce("up", "root").alias("root"))
        roots = stage(roots, "jaccard-roots")

    # A set of one document that links nothing is a component of its own and needs no row here.
    placed = classes.join(roots, "name", "left").where((F.col("copies") > 1) | F.col("root").isNotNull()).select("name", "rep", F.coalesce("root", "name").alias("root"))
    placed = stage(placed, "jaccard-placed")
    named = stage(placed.join(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("name", "component_id"), "jaccard-named")
    return meta.join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; all columns, repeated rows included."""
    found = jaccard_components(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, docs["doc_id"].cast("long") == first["doc_id"], "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
