"""Quality, BPE and decontamination: no shuffles, so plain functions and one pass each."""

import base64
import hashlib
import random

import numpy as np
import pytest

from quire.llm import op2_bpe as B
from quire.llm import op4_quality as Q
from quire.llm import op6_decontam as D

ODD = [None, "", " \n\t", "a", "a b c d e", "x" * 5000, "é ñ 日本 😀 ½²", "a\x85b\xa0c d"]


def docs(spark, texts, ids=None):
    """Extra columns with names that operators use themselves."""
    rows = [(i if ids is None else ids[i], t, "k", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id int, text string, kind string, n long")


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path, pattern = B.default_vocabulary()
    v = B.load(path)
    return path, pattern, v, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_equals_the_library(spark, tokenizer):
    path, pattern, _, enc = tokenizer
    rng = random.Random(5)
    texts = ODD + ["I'll we've 'S it's", "  lead  and trail  ", "#" * 300, "ab" * 3000] + ["".join(rng.choice("ab é\n\t'tslre1²#\x85\xa0ß٣日😀") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = {r.doc_id: r for r in B.round_trip(docs(spark, texts), path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_bpe_encode_decode_tables(spark, tokenizer):
    path, pattern, _, enc = tokenizer
    e = B.encode(docs(spark, ODD), path, pattern)
    assert {r.doc_id: r.ids for r in e.collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    assert {r.doc_id: bytes(r.bytes) for r in B.decode(e, path).collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert B.round_trip(docs(spark, []), path, pattern).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    keys = [b"%d" % i for i in range(5000)]
    h = B.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(5000)) and sorted(h.slot) == list(range(5000))
    assert h.get(b"other") == -1 and B.PerfectHash([]).get(b"x") == -1


def test_vocabulary_must_cover_bytes():
    with pytest.raises(ValueError, match="single byte"):
        B.Vocabulary([base64.b64encode(b"a") + b" 0"])


# ---------------------------------------------------------------- quality


def brute_quality(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + ["a a a a", "x\nx\n \n\nx", "# | <a> $%&*"] + [" ".join(rng.choice(["a", "b", "ça", "d\ne", "#", "\xa0"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    got = {r.doc_id: r for r in Q.judge_quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, *rest = want = brute_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and (not r.kept or not r.base_failed)


def test_compression_bands(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(vocab) for _ in range(900))
    # The same words in turn: no 3-word window repeats often enough for the base rule to need it, but it compresses.
    noise = base64.b64encode(rng.randbytes(6000)).decode()
    noise = " ".join(noise[i : i + 40] for i in range(0, len(noise), 40))
    repeat = " ".join(vocab[:200]) + " " + " ".join(vocab[:200])
    frame = docs(spark, [prose, noise, repeat * 4])
    got = {r.doc_id: r.kept for r in Q.judge_quality(frame).collect()}
    assert got == {0: True, 1: False, 2: False}
    assert [r.doc_id for r in Q.keep_good(frame).collect()] == [0] and Q.keep_good(frame).columns == frame.columns
    assert Q.judge_quality(docs(spark, [])).count() == 0


def test_bands_reject_junk_that_passes_the_base_rule(spark):
    rng = random.Random(8)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    vocab = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    junk = lambda n: " ".join(w + rng.choice(["###", "$$$", "%%%", "&&&", "***"]) for w in prose(n).split())
    good = [prose(n) for n in (150, 300, 600, 1200, 2500)]
    tail = prose(900)[: Q.CHUNK] + " a"  # the last chunk of two bytes leaves its band
    part = prose(1300) + " " + junk(600)
    bad = [junk(n) for n in (150, 300, 600, 1200, 2500)] + [part]
    got = {r.doc_id: r for r in Q.judge_quality(docs(spark, [*good, tail, *bad])).collect()}
    assert not any(r.base_failed for r in got.values()) and got[5].bad_chunks == 1
    assert [i for i in got if got[i].kept] == list(range(6))


# ---------------------------------------------------------------- decontamination


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    return rng, words, [words(30) for _ in range(6)]


def test_copies_are_found_and_clean_texts_are_not(spark, passages):
    rng, words, items = passages
    around = lambda x: " ".join(words(60) + x + words(60))
    edited = list(items[1])
    for i in (4, 15, 25):
        edited[i] = "zzz"
    dropped = items[2][:10] + items[2][12:]
    texts = [around(items[0]), around(edited), around(dropped), around([w.upper() for w in items[3]]), around(items[4][:20]), around([]), around(items[5][:5]), None, "", ",".join(items[0])]
    bench = spark.createDataFrame([(i, " ".join(x), "k") for i, x in enumerate(items)] + [(90, None, "k"), (91, "two words", "k")], "item_id int, text string, doc_id string")
    frame = docs(spark, texts)
    found = {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (9, 0)}
    assert sorted(r.doc_id for r in D.drop_contaminated(frame, bench).collect()) == [5, 6, 7, 8]
    assert D.contaminated(docs(spark, []), bench).count() == 0
    assert D.contaminated(frame, bench.where("false")).count() == 0 and D.drop_contaminated(frame, bench.where("false")).count() == len(texts)


def test_blocks_of_items_give_the_same_pairs(spark, passages, monkeypatch):
    rng, words, items = passages
    frame = docs(spark, [" ".join(words(20) + x) for x in items] * 2)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string")
    whole = {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()} == whole and len(whole) == 12


def test_pairs_equal_brute_force(spark):
    """Every document is aligned with every item in full, by a textbook matrix of its own."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    take = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [take(rng.randint(12, 40)) for _ in range(12)] + [take(2), []]
    texts = [take(60) for _ in range(10)]
    for k, x in enumerate(items[:12]):
        y = list(x)
        for _ in range(k % 5):
            y[rng.randrange(len(y))] = rng.choice(vocab)
        del y[3 : 3 + k % 3]
        y = y[: max(4, len(y) - 2 * k)] if k > 6 else y
        texts.append(take(15) + y + take(rng.randint(0, 15)))
    want = set()
    for d, w in enumerate(texts):
        for i, x in enumerate(items):
            h, m = np.zeros((len(x) + 1, len(w) + 1), int), np.zeros((len(x) + 1, len(w) + 1), int)
            for p in range(1, len(x) + 1):
                for q in range(1, len(w) + 1):
                    same = x[p - 1] == w[q - 1]
                    h[p, q], m[p, q] = max((h[p - 1, q - 1] + (2 if same else -1), m[p - 1, q - 1] + same), (h[p - 1, q] - 1, m[p - 1, q]), (h[p, q - 1] - 1, m[p, q - 1]), (0, 0), key=lambda z: z[0])
            at = h.argmax()
            if len(x) > 2 and h.flat[at] / (2 * len(x)) >= D.SHARE and m.flat[at] >= D.LEAST_WORDS:
                want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string")
    frame = docs(spark, [" ".join(w) for w in texts])
    assert {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()} == want and len(want) > 6
    left = {r.doc_id for r in D.drop_contaminated(frame, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}


def test_items_of_very_many_words(spark, passages):
    rng, words, items = passages
    many = [" ".join(f"{k}{i:x}" for i in range(1_100_000)) for k in "yz"]  # more than 2**21 different words together
    bench = spark.createDataFrame([(0, " ".join(items[0])), (1, many[0]), (2, many[1]), (3, " ".join(items[1]))], "item_id int, text string")
    frame = docs(spark, [" ".join(words(20) + x + words(20)) for x in items[:3]])
    assert {(r.doc_id, r.item_id) for r in D.contaminated(frame, bench).collect()} == {(0, 0), (1, 3)}


def test_alignment_over_a_very_long_text_keeps_its_memory():
    import tracemalloc

    item, doc = np.arange(1, 201), np.resize(np.arange(1, 51), 300_000)
    tracemalloc.start()
    score, matched, at = D.align(item, np.r_[doc, item])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (score, matched, at) == (400, 200, len(doc)) and peak < 100e6  # the whole matrix has 240 MB


def test_alignment_equals_the_textbook():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert D.align(np.array(a), np.array(b))[0] == h.max()
        score, matched, at = D.align(np.array(a), np.array(b))
        assert 2 * matched >= score and (not matched or b[at] == a[0] or b[at] in a)
