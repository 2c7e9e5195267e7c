"""Repeats, Jaccard components, connected components and the pipeline against brute force."""

import hashlib
import random
import re


import corpus_pipeline
from quire.llm import op9_repeats as R
from quire.llm import op10_jaccard as J
from quire.llm.components import connected
from tests.llm.test_text_ops import docs

# ---------------------------------------------------------------- repeats


def brute_repeats(rows):
    first, raws = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, r in raws:
        for p in range(len(r) - 49):
            w = r[p : p + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, r in raws:
        cover = bytearray(len(r))
        for p in range(len(r) - 49):
            if first[r[p : p + 50]] < d:
                cover[p : p + 50] = b"\1" * 50
        spans = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        out.append((d, len(r), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(r, cover) if not c)).hexdigest()))
    return sorted(out)


def repeat_texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    common = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(6)]
    texts = [None, "", "short", "#" * 300, "#" * 200 + "x", "ab" * 200, "ab" * 100, "\x00" * 120, "\x00" * 90 + "q", common[0] * 60]
    for _ in range(160):
        x = " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60)))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(common)
            y = p[rng.randint(0, len(p) // 2) :][: rng.randint(45, len(p))]
            if rng.random() < 0.4:
                k = rng.randrange(len(y))
                y = y[:k] + "Z" + y[k + 1 :]
            k = rng.randint(0, len(x))
            x = x[:k] + y + x[k:]
        texts.append(x)
    return texts + [common[0]] * 5


def test_repeats_equal_brute_force(spark):
    texts = repeat_texts()
    want = brute_repeats(list(enumerate(texts)))
    frame = docs(spark, texts).repartition(4)
    assert sorted(tuple(r) for r in R.remove_repeats(frame).collect()) == want
    # Every way around: anchors with many classes, joined side tables, long texts in pieces.
    forced = R.remove_repeats(frame, many=3, many_in_batch=4, broadcast_bytes=0, block=700)
    assert sorted(tuple(r) for r in forced.collect()) == want


def test_repeats_of_little(spark):
    assert R.remove_repeats(docs(spark, [])).count() == 0
    same = docs(spark, ["w" * 80, "w" * 80, "w" * 80], [7, 7, 9])
    assert sorted((r.doc_id, r.n_removed) for r in R.remove_repeats(same).collect()) == [(7, 0), (7, 0), (9, 80)]


def test_texts_of_one_doc_id_stay_apart(spark):
    import xxhash

    line = "one line of more than fifty bytes that another document holds as well"
    shared = line + " x"
    low = xxhash.xxh32_intdigest(shared.encode()) & 255
    # Another text of the same doc_id, equal in the lowest 8 bits of its hash.
    other = next(t for t in (f"{i} " + "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(90)) for i in range(9999)) if xxhash.xxh32_intdigest(t.encode()) & 255 == low)
    rows = R.remove_repeats(docs(spark, [line, shared, other], [1, 2, 2])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == sorted([(1, len(line), 0), (2, len(shared), len(line)), (2, len(other), 0)])


def test_a_line_that_a_text_repeats(spark):
    """Repeated contexts are asked about once; what is found holds wherever the text has them."""
    line = "a line of more than fifty bytes, such as headers and footers have it\n"
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    other = [f"{word()} {line}{word()} " for _ in range(12)]
    texts = ["".join(other), line * 40, line * 25 + "end " + line[:60] * 9, "x" + line[5:] * 30, "z " * 90 + (line[:55] + "!") * 20, "".join(f"{line}{word()}" for _ in range(30)), (line + "tail") * 20 + other[3] * 4]
    for order in (texts, texts[::-1]):
        want = brute_repeats(list(enumerate(order)))
        frame = docs(spark, order).repartition(3)
        assert sorted(tuple(r) for r in R.remove_repeats(frame).collect()) == want
        assert sorted(tuple(r) for r in R.remove_repeats(frame, many=3, many_in_batch=4, broadcast_bytes=0, block=700).collect()) == want


def test_a_line_repeated_very_often(spark):
    line = "a line of more than fifty bytes, such as headers and footers have it\n"
    n = 100_000
    rows = sorted(tuple(r) for r in R.remove_repeats(docs(spark, ["other words " + line + "and others", line * n + "end"]).repartition(2)).collect())
    # The first text holds the line between other words; of the second nothing but what spans two lines is new.
    assert rows[0][2] == 0 and rows[1][1] == len(line) * n + 3 and rows[1][2] == len(line) * n and rows[1][3] == 1


def test_maximal_repeats_give_all_occurrences():
    texts = [b"xxABCDEyy", b"zzABCDEqq", b"ABCDE", b"wwBCDEyy"]
    number, offset, common, left = R.suffix_array(texts, 3)
    got = {(texts[number[b]][offset[b] :][:n], frozenset(zip(number[b:e].tolist(), offset[b:e].tolist()))) for n, b, e in R.maximal_repeats(common, left, 3)}
    assert got == {
        (b"ABCDE", frozenset({(0, 2), (1, 2), (2, 0)})), (b"BCDE", frozenset({(0, 3), (1, 3), (2, 1), (3, 2)})), (b"BCDEyy", frozenset({(0, 3), (3, 2)})),
    }


# ---------------------------------------------------------------- Jaccard


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_jaccard(rows):
    sets, parent = sets_of(rows), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts(n_families=12, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    line = " ".join(vocab[:12])
    texts = [None, "", " \n", "a b", "A  B", "a b c", "one two three four five", "One two three four five", "x é ñ y z w", "x é ñ y z w q"]
    for f in range(n_families):
        base = [rng.choice(vocab) for _ in range(rng.randint(6, 150))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append((line + " " if rng.random() < 0.5 else "") + " ".join(w[: rng.randint(int(len(w) * 0.8), len(w))]))
    return texts + [texts[-1]] * 6


def test_components_equal_brute_force(spark):
    texts = near_texts()
    frame = docs(spark, texts).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(frame).collect()}
    assert got == brute_jaccard(list(enumerate(texts)))
    kept = {r.doc_id for r in J.keep_first(frame).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c} and J.keep_first(frame).columns == frame.columns


def test_components_by_shuffles_and_small_blocks(spark, monkeypatch):
    for name, value in (("BROADCAST_ROWS", 0), ("BLOCK_SETS", 3), ("BUCKET_BYTES", 1000)):
        monkeypatch.setattr(J, name, value)
    texts = near_texts(5, 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs(spark, texts)).collect()}
    assert got == brute_jaccard(list(enumerate(texts)))
    assert J.jaccard_components(docs(spark, [])).count() == 0


def test_large_group_in_many_blocks(spark, monkeypatch):
    """A chain of edits: most members link to a few others only, so blocks leave outliers."""
    monkeypatch.setattr(J, "BLOCK_SETS", 5)
    monkeypatch.setattr(J, "FREQUENT", 20)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(90):
        words[rng.randrange(100)] = f"e{i}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs(spark, texts).repartition(3)).collect()}
    assert got == brute_jaccard(list(enumerate(texts)))


def test_repeated_rows_and_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    near = long.replace("w20 ", "x ")
    texts = [long] * 500 + [near] * 500 + ["alone here with six words only", "other text under the same id", None, "null id and six words more"]
    ids = [7] * 500 + [8] * 500 + [3, 3, 3, None]
    got = sorted(tuple(r) for r in J.jaccard_components(docs(spark, texts, ids)).where("doc_id is not null").distinct().collect())
    assert got == [(3, 0, 3), (3, 2, 3), (7, 36, 7), (8, 36, 7)]
    rows = J.jaccard_components(docs(spark, texts, ids))
    assert rows.count() == len(texts) and [tuple(r) for r in rows.where("doc_id is null").collect()] == [(None, 2, None)]
    # A text whose only doc_id is null still links the others.
    got = {(r.doc_id, r.component_id) for r in J.jaccard_components(docs(spark, [long, near], [None, 5])).collect()}
    assert got == {(None, 5), (5, 5)}


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    edited = list(words)
    for i in range(0, 60_000, 120):
        edited[i] = "edit"
    texts = [" ".join(words), " ".join(edited), "x" * 300_000]
    got = [(r.doc_id, r.component_id) for r in J.jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(0, 0), (1, 0), (2, 2)]


def test_bitmaps_never_understate_the_overlap():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        bits = J.Bitmaps([len(a), len(b)], [J.bitmap(a), J.bitmap(b)])
        assert bits.bounds(0, np.array([1]))[0] >= len(np.intersect1d(a, b)) and bits.bounds(1, np.array([0]))[0] >= len(np.intersect1d(a, b))


def test_prefixes_share_what_links_must_share():
    import numpy as np

    rng = np.random.default_rng(3)
    for often in (0, 60):
        for _ in range(300):
            n = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            order = J.Order(rng.permutation(a)[:often])
            b = a.copy()
            k = int(rng.integers(0, max(1, len(a) // 4) + 1))
            b[rng.choice(len(b), min(k, len(b)), replace=False)] = rng.integers(0, 2**63, min(k, len(b)), dtype=np.uint64)
            b = np.unique(b)
            if J.linked(len(a), len(b), len(np.intersect1d(a, b))):
                (ra, fa), (rb, fb) = order.prefix(a), order.prefix(b)
                assert len(np.intersect1d(ra, rb)) + len(np.intersect1d(fa, fb)) >= min(J.least_shared(len(a)), J.least_shared(len(b)))


def test_connected_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    import tiktoken
    import zstandard

    from quire.llm import op2_bpe, op4_quality

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [" ".join(words(30)) for _ in range(3)]
    key = hashlib.sha1(b"x").hexdigest()
    base = words(120)
    near = list(base)
    near[60] = "edited"
    texts = {0: " ".join(base), 1: " ".join(near), 2: " ".join(base), 3: " ".join(words(80)) + f' token = "{key}" ' + " ".join(words(20)), 4: " ".join(words(60)) + " " + bench[1] + " " + " ".join(words(40)),
             5: "spam " * 200, 6: "too short", 7: " ".join(words(200)), 8: None, 9: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    compress = zstandard.ZstdCompressor(level=op4_quality.LEVEL).compress
    kept = {i: t for i, t in texts.items() if op4_quality.judge(t, compress)[6]}
    firsts = {i for i, (_, c) in brute_jaccard(list(kept.items())).items() if i == c}
    left = {i: t.replace(key, "[SECRET]") for i, t in kept.items() if i in firsts and not any(b in t for b in bench)}
    assert set(left) == {0, 3, 7} == set(got)
    path, pattern = op2_bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op2_bpe.load(path).ranks, special_tokens={})
    for i, t in left.items():
        assert got[i].n_tokens == len(enc.encode_ordinary(t)) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_the_columns(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, frame, str(tmp_path)).columns == frame.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
