"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased (every byte beyond ASCII is a
letter).  Features are words, pairs of neighbours and pairs with one word
between them, hashed to ``2**BITS`` numbers; a feature is there or not, however
often.  All features of an Arrow batch are found at once: word hashes are
differences of a running polynomial hash of the batch's bytes, pair hashes mix
those of two words, and no Python loop sees a word.

Learning is FTRL-proximal (McMahan et al. 2013): learning rates by coordinate,
L1 that leaves most weights at exactly zero.  It runs on ``TRAIN_DOCS`` labelled
documents, chosen by a hash of their ids among all labelled ones (a fixed
bound; fewer where there are fewer), whole texts, in shards of about
``SHARD_DOCS``, a task each.  In each of ``ROUNDS`` rounds every shard goes on from the merged weights over its own
documents and gives its nonzero coordinates with the squared gradients it saw;
a coordinate's new weight is the mean of its shards' weights by these.  The
weights that are left are a few thousand, which is what scoring broadcasts;
``MAX_WEIGHTS`` is a bound on that, above which the smallest are dropped.

Defined results: null and empty texts have no feature and get the score of the
constant; texts are scored whole; only labels 0 and 1 are learnt from (of
several labels of a doc_id, 1 counts); a null doc_id is held out by nothing
(its remainder is that of the empty text) and has no label; without labelled
documents of both kinds every score is the share of label 1 that was seen, or
0; repeated rows are learnt from once and each scored; an empty table gives no
rows; other columns, ``lang`` and ``source`` among them, are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stage, table

BITS = 26
TRAIN_DOCS, SHARD_DOCS, ROUNDS = 36_000, 4_500, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
MAX_WEIGHTS = 1 << 18
THRESHOLD = 0.3
HELD_OUT = 2
#: The constant feature; no hash is negative.
CONSTANT = -1

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPACE = re.compile(r"\s")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WORD = np.zeros(256, dtype=bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True
#: Characters of a portion of texts; a longer text is a portion of its own, hashed in pieces.
PORTION = 1 << 20


# ---------------------------------------------------------------- features


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about ``PORTION`` characters that end at white space."""
    at = 0
    while len(text) - at > PORTION:
        end = _SPACE.search(text, at + PORTION)
        if not end:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and the number of the text of each."""
    if len(texts) == 1:
        found = np.concatenate([_hashes([p])[0] for p in _pieces(texts[0])])
        return found, np.zeros(len(found), np.int64)
    return _hashes(texts)


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raws = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    edges = np.diff(np.concatenate(([False], _WORD[data], [False])).astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # Running sums of byte x power; the difference over a word, shifted back to its start, is the word's own hash.
    room = 1 << max(16, int(len(data)).bit_length())
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(room, _ODD)[: len(data)])))
    hashes = _scramble((running[end] - running[begin]) * _powers(room, _INVERSE)[begin])
    last = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.searchsorted(last, begin, side="right")


def features_of(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the number of the text of each; a feature may repeat."""
    h, doc = words_of(texts)
    found, owner = [h], [doc]
    for gap, salt in ((1, np.uint64(0x632BE59BD9B4E019)), (2, np.uint64(0xD1342543DE82EF95))):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(_scramble((h[:-gap] * np.uint64(_ODD) + h[gap:]) ^ salt)[same])
            owner.append(doc[gap:][same])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int32), np.concatenate(owner)


def portions(texts: list[str]) -> Iterator[slice]:
    """Slices of ``texts`` of about ``PORTION`` characters."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > PORTION:
            yield slice(at, i)
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


# ---------------------------------------------------------------- learning


class Model(NamedTuple):
    """Weights of the features that have one, in ascending order of ``ids``; ``CONSTANT`` may be among them."""

    ids: np.ndarray
    weights: np.ndarray
    counts: np.ndarray  # sums of squared gradients

    @classmethod
    def empty(cls, share: float = 0.0) -> Model:
        return cls(np.array([CONSTANT]), np.array([np.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share >= 1 else -40.0)]), np.zeros(1))


def _often(documents: list[np.ndarray]) -> np.ndarray:
    """Features of more than ``L1`` documents, ascending."""
    known, seen = np.unique(np.concatenate([np.zeros(0, np.int32), *documents]), return_counts=True)
    return known[seen > L1]


def _within(own: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``own`` are among the ascending ``known``."""
    if not len(known):
        return np.zeros(len(own), bool)
    return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own


def learn(documents: list[np.ndarray], labels: list[int], model: Model) -> Model:
    """One pass of FTRL-proximal over documents (arrays of different features), going on from ``model``.

    A gradient is below 1, so L1 holds a feature of ``L1`` documents or fewer at
    zero for the whole pass; such features are left out before, unless ``model`` has them.
    """
    known = np.setdiff1d(np.union1d(_often(documents), model.ids), [CONSTANT])
    ids = np.concatenate(([CONSTANT], known))
    own = [d[_within(d, known)] for d in documents]
    places = np.searchsorted(ids, np.concatenate([np.zeros(0, np.int64), *own]))
    edges = np.cumsum([0, *map(len, own)])

    n, z = np.zeros(len(ids)), np.zeros(len(ids))
    penalty, shrink = np.full(len(ids), L1), np.full(len(ids), L2)
    penalty[0] = 0.0  # the constant is not regularised
    at = np.searchsorted(ids, model.ids)
    n[at] = model.counts
    # The state that has the merged weights.
    z[at] = -model.weights * ((BETA + np.sqrt(model.counts)) / ALPHA + shrink[at]) - np.sign(model.weights) * penalty[at]

    def weights(i):
        return np.where(np.abs(z[i]) > penalty[i], -(z[i] - np.sign(z[i]) * penalty[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + shrink[i]), 0.0)

    before = n.copy()
    for a, b, y in zip(edges[:-1], edges[1:], labels):
        i = np.concatenate(([0], places[a:b]))
        w = weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -40, 40))) - y
        root = np.sqrt(n[i])
        n[i] += g * g
        z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    w = weights(slice(None))
    keep = (w != 0) | (ids == CONSTANT)
    return Model(ids[keep], w[keep], (n - before)[keep])


def frequent(documents: list[np.ndarray]) -> list[np.ndarray]:
    """The documents without the features that ``learn`` leaves out of a shard by itself."""
    known = _often(documents)
    return [d[_within(d, known)] for d in documents]


def _sample(labels: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """``doc_id, y`` of at most about ``most`` labelled documents that are not held out; how many are labelled, and how many of them 1."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    marks = marks.where(~held_out(F.col("doc_id")))
    n, ones = marks.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n > most:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 40)) < int(most / n * (1 << 40)))
    return marks, n, ones


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == HELD_OUT


def _featured(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, at, y, x``: the different features of each training text, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ys, texts = (c.to_pylist() for c in b.columns)
            for part in portions(texts):
                x, doc = features_of(texts[part])
                order = np.argsort(doc, kind="stable")
                x, cut = x[order], np.searchsorted(doc[order], np.arange(part.stop - part.start + 1))
                own = [np.unique(x[a:z]) for a, z in zip(cut[:-1], cut[1:])]
                place = [zlib.crc32(str(i).encode()) for i in ids[part]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p % shards for p in place], pa.int32()), pa.array(place, pa.int64()), pa.array(ys[part], pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["shard", "at", "y", "x"])

    return rows.mapInArrow(run, "shard int, at long, y int, x array<int>")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Weights learnt from labelled documents that are not held out."""
    spark = docs.sparkSession
    marks, n, ones = _sample(labels, most)
    if not n or ones in (0, n):
        return Model.empty(ones / n if n else 0.0)
    # At most about `most` ids and labels, which is what is broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id")
    rows = rows.select("doc_id", "y", "text").dropDuplicates(["doc_id", "text"])

    def prune(part):
        part = part.sort_values("at", kind="stable")
        return part.assign(x=frequent(list(part["x"])))

    shards = -(-min(n, most) // SHARD_DOCS)
    featured = stage(_featured(rows, shards).groupBy("shard").applyInPandas(prune, "shard int, at long, y int, x array<int>"), "toxicity-features")
    model = Model.empty(ones / n)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(tuple(model))

        def one(part):
            import pandas as pd

            part = part.sort_values("at", kind="stable")
            got = learn(list(part["x"]), part["y"].tolist(), Model(*shared.value))
            return pd.DataFrame({"id": got.ids, "w": got.weights, "c": got.counts})

        pieces = featured.groupBy("shard").applyInPandas(one, "id long, w double, c double")
        weight = F.sum(F.col("w") * F.col("c")) / F.sum("c")
        merged = pieces.where("c > 0").groupBy("id").agg(weight.alias("w"), F.sum("c").alias("c"))
        # A bounded table: the largest weights.
        got = merged.orderBy(F.desc(F.col("id") == CONSTANT), F.desc(F.abs("w")), "id").limit(MAX_WEIGHTS).toPandas().sort_values("id")
        counts = got["c"].to_numpy()
        if len(model.ids) > 1:
            old = dict(zip(model.ids.tolist(), model.counts.tolist()))
            counts = counts + np.array([old.get(i, 0.0) for i in got["id"].tolist()])
        model = Model(got["id"].to_numpy(), got["w"].to_numpy(), counts)
    discard(featured)
    return model


# ---------------------------------------------------------------- scoring


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = np.full(len(texts), float(model.weights[model.ids == CONSTANT].sum()))
    for part in portions(texts):
        x, doc = features_of(texts[part])
        at = np.minimum(np.searchsorted(model.ids, x), len(model.ids) - 1)
        hit = model.ids[at] == x
        # Each feature of a text counts once.
        pair = np.unique(np.stack((doc[hit], at[hit]), axis=1), axis=0)
        out[part] += np.bincount(pair[:, 0], weights=model.weights[pair[:, 1]], minlength=part.stop - part.start)
    return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = scores([t or "" for t in b.column(1).to_pylist()], Model(*shared.value))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
