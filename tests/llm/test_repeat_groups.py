"""Maximal repeat groups with all their occurrences against every substring of small texts."""

import random
from collections import defaultdict

from quire.llm import repeat_groups as G
from tests.llm.test_text_ops import docs


def brute_groups(rows):
    """(string, its occurrences) of all maximal repeats; ends of texts differ from everything."""
    at = defaultdict(set)
    for d, t in set(rows):
        raw = (t or "").encode()
        for a in range(len(raw)):
            for z in range(a + G.LENGTH, len(raw) + 1):
                at[raw[a:z]].add((d, raw, a))
    out = set()
    for w, places in at.items():
        before = {raw[a - 1] if a else ("start", d, raw) for d, raw, a in places}
        after = {raw[a + len(w)] if a + len(w) < len(raw) else ("end", d, raw) for d, raw, a in places}
        if len(places) > 1 and len(before) > 1 and len(after) > 1:
            out.add((w, frozenset((d, a) for d, _, a in places)))
    return out


def groups(frame, rows, **limits):
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append((t or "").encode())
    own = defaultdict(list)
    for r in G.repeat_groups(frame, **limits).collect():
        own[(r.group, r.length)].append((r.doc_id, r.version, r.first))
    out = set()
    for (_, n), places in own.items():
        assert len(places) == len(set(places))
        # With ids that are not repeated the strings can be read back, and are all equal.
        words = {w for d, _, a in places for w in (x[a : a + n] for x in texts[d]) if len(w) == n}
        if len({len(x) for d, *_ in places for x in [texts[d]]}) == 1 and len(texts[places[0][0]]) == 1:
            assert len(words) == 1
        out.add((max(words, key=lambda w: sum(any(x[a : a + n] == w for x in texts[d]) for d, _, a in places)), frozenset((d, a) for d, _, a in places)))
    assert len(out) == len(own)
    return out


def some_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    common = [" ".join(word() for _ in range(n)) for n in (20, 40, 90)]
    texts = [None, "", "short", "#" * 130, "#" * 70 + "x", "ab" * 60, "\x00" * 60, "\x00" * 55 + "q", "line of words that comes again and again, so it is long;" * 4]
    for _ in range(24):
        p = rng.choice(common)
        y = p[rng.randint(0, len(p) // 2) :][: rng.randint(45, len(p))]
        if rng.random() < 0.4:
            k = rng.randrange(len(y))
            y = y[:k] + "Z" + y[k + 1 :]
        texts.append(word() * rng.randint(0, 3) + y + word() * rng.randint(0, 3))
    return texts + [common[0]] * 3 + [common[1], common[1] + "!"]


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(some_texts()))
    want = brute_groups(rows)
    assert len(want) > 100
    frame = docs(spark, [t for _, t in rows]).repartition(3)
    assert groups(frame, rows) == want
    # Nodes with several leaves by prefixes instead of the scan; then all of them.
    assert groups(frame, rows, many=3) == want
    assert groups(frame, rows, many=0) == want


def test_groups_of_little(spark):
    assert G.repeat_groups(docs(spark, [])).count() == 0
    line = "a line of sixty bytes that both of the texts hold in full ...."
    # Equal rows of an id count once; two texts of an id are two.
    same = docs(spark, [line, line, line + "!", line], [7, 7, 7, 9])
    found = sorted((r.length, r.doc_id, r.first) for r in G.repeat_groups(same).collect())
    assert found == [(len(line), 7, 0), (len(line), 7, 0), (len(line), 9, 0)]
    assert G.repeat_groups(docs(spark, [None, "", line[:49], line[:49]])).count() == 0


def test_long_copies_end_where_texts_differ(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(30_000))
    cut = len(prose) // 3
    texts = ["x" + prose, "y" + prose + "z", prose[:cut] + "%" + prose[cut + 1 :], "other " + prose[1000:4000] + "?"]
    found = {}
    for r in G.repeat_groups(docs(spark, texts)).collect():
        found.setdefault((r.length, r.group), []).append((r.doc_id, r.first))
    assert sorted((n, sorted(x)) for (n, _), x in found.items()) == sorted([
        (len(prose), [(0, 1), (1, 1)]),
        (cut, [(0, 1), (1, 1), (2, 0)]),
        (len(prose) - cut - 1, [(0, cut + 2), (1, cut + 2), (2, cut + 1)]),
        (3000, [(0, 1001), (1, 1001), (2, 1000), (3, 6)]),
    ])


def test_columns_with_other_names_do_not_matter(spark):
    from pyspark.sql import functions as F

    line = "one line of more than fifty bytes, held by two documents"
    frame = docs(spark, [line, "<" + line])
    for name in ("version", "first", "node", "leaf", "anchor", "level", "asked"):
        frame = frame.withColumn(name, F.lit("other"))
    assert sorted((r.length, r.doc_id, r.first) for r in G.repeat_groups(frame).collect()) == [(len(line), 0, 0), (len(line), 1, 1)]
