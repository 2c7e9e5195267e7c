"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are word trigrams of test items that are rare by chance: the product of
their words' shares, counted over all documents, is at most ``RARE``.  (Counting
documents that hold the trigram instead would make a much-copied test passage
look common.)  Items with fewer than ``FEW`` rare trigrams keep all of theirs.
Documents meet the seeds in a lookup join on the trigram; around each hit, the
item is aligned with the document's words (Smith-Waterman, match 2, mismatch and
gap -1), so edited, shortened or paraphrased copies score by what they share.

Test items are the smaller side but may be many: they are taken in blocks of at
most ``BLOCK_BYTES`` and fewer than ``MOST_WORDS`` different words, each block one
pass over the documents, so what a task holds is bounded.  Documents never move: there is no shuffle of texts.

Defined results: null and empty texts hit nothing; items with fewer than three
words or null text match nothing; equal items each give a pair; repeated
documents each give their pairs; an empty table on either side gives no pairs;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

BLOCK_BYTES = 32 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
RARE = 1e-8
FEW = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: A document is contaminated by an item if the alignment reaches this share of the item's own score ...
SHARE = 0.45
#: ... and at least so many words match.
LEAST_WORDS = 8

SCHEMA = "doc_id long, item_id long, score int, share double, n_matched int, first_word int"

_TABLE = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Case-folded words of letters and digits; characters beyond ASCII count as letters."""
    return (text or "").casefold().encode("utf-8", "replace").translate(_TABLE).split()


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two id arrays: (score, matched words, start in ``doc``).

    Row by row, with the start and the matches of each cell's best path carried along, so memory is that of ``doc``.
    """
    n = len(doc)
    steps = np.arange(n + 1)
    score, start, matched = np.zeros(n + 1, np.int64), steps.copy(), np.zeros(n + 1, np.int64)
    top = (0, 0, 0)
    for word in item:
        same = doc == word
        diagonal = score[:-1] + np.where(same, MATCH, MISMATCH)
        best, begin, hits = np.maximum(score + GAP, 0), start.copy(), matched.copy()
        by = np.flatnonzero((diagonal >= best[1:]) & (diagonal > 0))
        best[by + 1], begin[by + 1], hits[by + 1] = diagonal[by], start[by], matched[by] + same[by]
        # A gap in the item costs 1 a word: the running maximum of best[j] + j, less j; the last cell that attains it is the source.
        lifted = best - GAP * steps
        running = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == running, steps, 0))
        score, start, matched = running + GAP * steps, begin[source], hits[source]
        ended = score <= 0
        score[0], ended[0] = 0, True
        start[ended], matched[ended] = steps[ended], 0
        j = int(score.argmax())
        if score[j] > top[0]:
            top = (int(score[j]), int(matched[j]), int(start[j]))
    return top


class Seeds:
    """A block of test items and the table of their rare trigrams."""

    def __init__(self, items: list[tuple[int, list[bytes]]], vocab: dict[bytes, int], share: np.ndarray):
        self.vocab, self.base = vocab, len(vocab) + 1
        self.items, keys, owners, places = [], [], [], []
        for number, (item_id, w) in enumerate(items):
            ids = np.fromiter((vocab[x] for x in w), np.int64, len(w))
            self.items.append((item_id, ids))
            if len(ids) < 3:
                continue
            grams = self.grams(ids)
            rare = share[ids[:-2]] * share[ids[1:-1]] * share[ids[2:]] <= RARE
            if rare.sum() < FEW:
                rare[:] = True
            at = np.flatnonzero(rare)
            keys.append(grams[at])
            owners.append(np.full(len(at), number))
            places.append(at)
        order = np.argsort(np.concatenate(keys), kind="stable") if keys else np.empty(0, int)
        self.keys, self.owners, self.places = (
            (np.concatenate(x)[order] if keys else np.empty(0, np.uint64)) for x in (keys, owners, places)
        )

    @staticmethod
    def grams(ids: np.ndarray) -> np.ndarray:
        """Hashed trigrams of word ids; those that fall together cost an alignment, no result."""
        with np.errstate(over="ignore"):
            x, y, z = (ids[i : len(ids) - 2 + i].astype(np.uint64) for i in range(3))
            h = ((x * _ODD[0] + y) * _ODD[1] + z) * _ODD[2]
            return h ^ (h >> np.uint64(31))

    def hits(self, text: str | None) -> list[tuple[int, int, int, float, int]]:
        """(item number, score, matched, share, first word) of each item that reaches the limits."""
        w = words(text)
        if len(w) < 3 or not len(self.keys):
            return []
        ids = np.fromiter(map(self.vocab.get, w, repeat(0)), np.int64, len(w))
        spots = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
        if not len(spots):
            return []
        grams = self.grams(ids)[spots]
        low = np.searchsorted(self.keys, grams, "left")
        found = np.searchsorted(self.keys, grams, "right") - low
        if not found.any():
            return []
        spans: dict[int, list[int]] = {}
        for k in np.flatnonzero(found):
            for x in range(low[k], low[k] + found[k]):
                spans.setdefault(int(self.owners[x]), []).append(int(spots[k]) - int(self.places[x]))
        out = []
        for number, begins in spans.items():
            item = self.items[number][1]
            pad = len(item) // 2 + 2
            best = (0, 0, 0)
            begins.sort()
            i = 0
            while i < len(begins):  # hits whose windows overlap are aligned together
                j = i
                while j + 1 < len(begins) and begins[j + 1] - begins[j] <= 2 * pad:
                    j += 1
                first, last = max(0, begins[i] - pad), min(len(ids), begins[j] + len(item) + pad)
                score, matched, at = align(item, ids[first:last])
                best = max(best, (score, matched, -(first + at)))
                i = j + 1
            share = best[0] / (MATCH * len(item))
            if share >= SHARE and best[1] >= min(LEAST_WORDS, len(item)):
                out.append((number, best[0], best[1], share, -best[2]))
        return out


def _count_words(vocab):
    size = len(vocab.value) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total, sums = vocab.value.get, 0, np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                w = words(text.as_py())
                total += len(w)
                sums += np.bincount(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)), minlength=size) if w else 0
        sums[0] = total
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["word", "n"])

    return run


def seed_blocks(docs: DataFrame, items: DataFrame) -> Iterator:
    """Broadcast ``Seeds`` of the test items, in blocks of a bounded size; the next one is made when it is asked for."""
    spark = docs.sparkSession
    clean = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        own = clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        listed = [(r.item_id, words(r.text)) for r in own]
        vocab = {w: i for i, w in enumerate(sorted({w for _, x in listed for w in x}), 1)}
        if not vocab:
            continue
        shared = spark.sparkContext.broadcast(vocab)
        counted = docs.select("text").mapInArrow(_count_words(shared), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(vocab) + 1)
        for r in counted:  # one row a word of the block
            counts[r.word] = r.n
        shared.destroy()
        yield spark.sparkContext.broadcast(Seeds(listed, vocab, np.maximum(counts, 1) / max(counts[0], 1))), blocks


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs ``doc_id, item_id, score, share, n_matched, first_word`` of documents that hold a test item."""

    def scan(seeds):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = seeds.value
            for batch in batches:
                rows = [
                    (d, block.items[n][0], score, share, matched, at)
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1))
                    for n, score, matched, share, at in block.hits(t.as_py())
                ]
                c = list(zip(*rows)) if rows else [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "item_id", "score", "share", "n_matched", "first_word"]
                )

        return run

    narrow = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    out = None
    for seeds, blocks in seed_blocks(docs, items):
        found = narrow.mapInArrow(scan(seeds), SCHEMA)
        if blocks > 1:  # written before the next block's seeds are made
            found = stage(found, "decontam-pairs")
            seeds.destroy()
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no test item; judged in place, without a join."""
    everything = docs
    for seeds, blocks in seed_blocks(everything, items):

        @F.pandas_udf("boolean")
        def clean(texts, seeds=seeds):
            return texts.map(lambda t: not seeds.value.hits(t)).astype(bool)

        docs = docs.where(clean("text"))
        if blocks > 1:
            docs = stage(docs, "decontam-left")
            seeds.destroy()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
