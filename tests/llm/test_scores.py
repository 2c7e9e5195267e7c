"""Whitening, toxicity and the filter audit against brute force, numpy and DuckDB."""

import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import op11_whitening as W
from quire.llm import op12_toxicity as T
from quire.llm import op13_audit as A

# ---------------------------------------------------------------- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n string")


def test_exact_moments():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (700, 5))
    sums = x.sum(axis=0).tolist()
    high, low = W.outer_sum(W.centred(x.astype(float), W.quotient(sums, len(x))))
    for i in range(5):
        for j in range(5):
            true = sum((Fraction(int(r[i])) - Fraction(sums[i], 700)) * (Fraction(int(r[j])) - Fraction(sums[j], 700)) for r in x)
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - true) < Fraction(1, 10**20) * max(1, abs(true))


def test_cancellation():
    # Small differences on a large offset, where plain sums of squares lose everything.
    x = np.array([[1e9 + i % 3, (i % 3) * 2.0] for i in range(900)])
    mean = W.quotient([int(v) for v in x.sum(axis=0)], len(x))
    high, low = W.outer_sum(W.centred(x, mean))
    assert np.allclose(high + low, [[600.0, 1200.0], [1200.0, 2400.0]], rtol=1e-15)


def test_whitened_rows(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 6)) @ np.diag([3, 2.5, 2, 1, 0.5, 0.2])).tolist()
    rows = list(enumerate([*base, *base[:50], *[base[0]] * 100]))
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, [])]
    got = W.whiten(vectors(spark, rows + bad)).toPandas().sort_values(["component", "vec_id"])
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(u.T, bias=True))
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for k in range(4):
        part = got[got["component"] == k + 1]
        want = (x - s / n) @ v[:, -1 - k] / np.sqrt(e[-1 - k])
        assert min(np.abs(part["whitened"] - want).max(), np.abs(part["whitened"] + want).max()) < 1e-9
        assert np.allclose(part["explained"], e[-1 - k] / e.sum(), rtol=1e-9)
        assert part["deviation"].tolist() == ((n * x - s) ** 2).sum(axis=1).tolist()


def test_vectors_without_variance(spark):
    got = W.whiten(vectors(spark, [(1, [0.5, 1.0]), (None, [0.5, 1.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    got = W.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [1.5, 1.0])])).orderBy("vec_id", "component").collect()
    assert [abs(r.whitened) if r.whitened is not None else None for r in got] == [1.0, None] * 2 and [r.explained for r in got] == [1.0, 0.0] * 2
    assert W.whiten(vectors(spark, [])).count() == 0 and W.whiten(vectors(spark, [(1, None)])).count() == 0


# ---------------------------------------------------------------- toxicity


def plain_features(text, bits=T.BITS):
    """Feature numbers word by word."""
    words = [w.encode() for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())]
    wrap = (1 << 64) - 1

    def scramble(h):
        h = ((h ^ (h >> 30)) * int(T._MIX[0])) & wrap
        h = ((h ^ (h >> 27)) * int(T._MIX[1])) & wrap
        return h ^ (h >> 31)

    hashes = [scramble(sum((b + 1) * pow(T._ODD, i, 1 << 64) for i, b in enumerate(w)) & wrap) for w in words]
    out = list(hashes)
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xD1342543DE82EF95)):
        out += [scramble(((a * T._ODD + b) & wrap) ^ salt) for a, b in zip(hashes, hashes[gap:])]
    return sorted(h >> (64 - bits) for h in out)


@pytest.mark.parametrize("portion", [1 << 20, 40])
def test_features_word_by_word(portion, monkeypatch):
    monkeypatch.setattr(T, "PORTION", portion)
    texts = ["One two, THREE four", "", "ÄÖ é x9 ...", "one", "a" * 3 + " b" * 60 + "\n\tend"]
    for part in T.portions(texts):
        found, doc = T.features_of(texts[part])
        for i, t in enumerate(texts[part]):
            assert sorted(found[doc == i].tolist()) == plain_features(t)
    assert [texts[s] for s in T.portions(texts)] and sum((texts[s] for s in T.portions(texts)), []) == texts


def toxic_tables(spark, n=900):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        body = rng.choice(words, 30).tolist()
        if i % 6 == 0:
            body[int(rng.integers(30))] = "Vile!"
        elif i % 6 == 1:
            body[3:5] = ["so", "bad"]  # a pair is toxic, its words apart are not
        elif i % 6 == 2:
            body[3], body[9] = "so", "bad"
        docs.append((i, " ".join(body), "en" if i % 6 < 2 else "de", "s"))
        labels.append((i, 1, int(i % 6 < 2)))
    docs += [(None, "vile", "x", "x"), (n, None, "en", "s"), (n + 1, "", "en", "s"), (n + 2, "vile " * 50000, "de", "s"), (0, docs[0][1], "en", "s")]
    labels += [(0, 1, 0), (n + 9, 1, 1), (5, 1, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = toxic_tables(spark)
    rows = T.score(docs, T.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 150 and sum(r.predicted == (r.doc_id % 6 < 2) for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r.score for r in rows}
    assert by[900] == by[901] and by[902] > 0.3


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = toxic_tables(spark, 300)
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.train(docs, x) for x in (labels, flipped))
    assert a.ids.tolist() == b.ids.tolist() and np.allclose(a.weights, b.weights)


def test_nothing_to_learn(spark):
    docs, labels = toxic_tables(spark, 12)
    none = T.score(docs, T.train(docs, labels.limit(0))).agg(F.max("score")).first()[0]
    ones = T.score(docs, T.train(docs, labels.withColumn("toxic", F.lit(1)))).agg(F.min("score")).first()[0]
    assert none < 1e-9 and ones > 1 - 1e-9
    assert T.score(docs.limit(0), T.Model.empty()).count() == 0


def test_shards_agree_with_one_pass():
    rng = np.random.default_rng(4)
    documents = [np.unique(np.concatenate((rng.integers(10, 4000, 40), [7] if i % 3 == 0 else []))).astype(np.int32) for i in range(600)]
    model = T.learn(documents, [int(i % 3 == 0) for i in range(600)], T.Model.empty(1 / 3))
    assert set(model.ids) <= {T.CONSTANT, *range(4000)} and model.weights[list(model.ids).index(7)] > 2
    pruned = T.learn(T.frequent(documents), [int(i % 3 == 0) for i in range(600)], T.Model.empty(1 / 3))
    assert pruned.ids.tolist() == model.ids.tolist() and np.allclose(pruned.weights, model.weights)


# ---------------------------------------------------------------- filter audit


def audit_truth(docs, labels):
    """Filters applied one after the other, document by document."""
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((source or "", fails, i in good, i in toxic))
    out, removals = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [r for r in left if r[1][f]]
                again = sum(r[1][f] for r in gone)
                left = [r for r in left if not r[1][f]]
                gone += hit
                lone = sum(r[0] == part and [k for k in "ABCDE" if r[1][k]] == [f] for r in rows)
                out[part, "".join(order), step] = (len(left), len(hit), again, lone, sum(r[2] for r in hit), sum(r[3] for r in hit))
                removals[part, f] = removals.get((part, f), 0) + len(hit)
    return {(*k, *v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(1, long, "a"), (2, long, "a"), (3, long, "b"), (2, long, "b"), (None, long, "a"), (4, "UPPER CASE", None), (5, "UPPER CASE", ""), (6, None, None), (7, "", "a"), (8, "w " * 80, "b"), (9, "w " * 80 + "#", "b"),
            (10, long + " $", "a"), (11, "x" * 5000, "a"), (12, "ÄÖÜ é " * 30, "a"), (-3, long + " $", "b"), (12, "ÄÖÜ é " * 30, "a")]
    labels = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (8, None, 1), (9, 1, None), (99, 1, 1), (None, 1, 1), (12, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit(A.mask_cells(frame, marks))
    assert {tuple(r) for r in got.select("part", "filter_order", "step", *A.METRICS, "shapley").collect()} == audit_truth(docs, labels)
    assert A.audit(A.mask_cells(frame.limit(0), marks)).count() == 0
