"""The secret scan word by word in Python, with the same trained forest."""

import hashlib
import random

import regex
from pyspark.sql import functions as F

from quire.llm import op5_secrets as X


def count(pattern, s):
    return len(regex.findall(pattern, s))


def share(s, drop):
    return len(regex.sub(drop, "", s)) / len(s)


def features(s, word, before, after):
    around = " ".join(x for x in (before, word, after) if x is not None).lower()
    ahead = " ".join((before, word.replace(s, " "))).lower()
    head = word[: word.index(s)] if s in word else word
    low = s.lower()
    return {
        "length": float(len(s)), "transitions": (sum(count(p, s) for p in ("[a-z]+", "[A-Z]+", "[0-9]+", "[^A-Za-z0-9]+")) - 1) / len(s), "digits": share(s, "[^0-9]"), "hexadecimal": share(s, "[^0-9a-fA-F]"),
        "upper": share(s, "[^A-Z]"), "dictionary": 1 - share(low, "|".join(X.FRAGMENTS)), "distinct": len(set(s)) / min(len(s), 64), "vowels": share(low, "[^aeiouy]"), "path": float(count("[/.]", word)),
        "near_secret": float(bool(regex.search(X.NEAR_SECRET, ahead))), "near_other": float(bool(regex.search(X.NEAR_OTHER, ahead))), "placeholder": float(bool(regex.search(X.PLACEHOLDER, around))),
        "assigned": float(bool(regex.search(r"[=:]>?\s*[\"'`]?$", f"{before} {head}"))), "quoted": float(bool(regex.search("[\"'`]", word))),
    }


def score(forest, x):
    def tree(node):
        if isinstance(node, float):
            return node
        name, at, left, right = node
        return tree(left if x[name] <= at else right)

    return sum(map(tree, forest)) / len(forest)


def scan(docs, forest):
    out = []
    for i, text in docs:
        words = regex.split(r"[\x20\x09-\x0D]+", text or "")
        at = lambda k: words[k] if 0 <= k < len(words) else None
        for k, w in enumerate(words):
            joined = " ".join(x for x in (at(k - 2), at(k - 1), w) if x is not None)
            before, after = " ".join(x for x in (at(k - 2), at(k - 1)) if x is not None), at(k + 1) or ""
            values = [m for m in dict.fromkeys(regex.findall(X.BESIDE, joined)) if m in w]
            runs = [m for m in dict.fromkeys(regex.findall(X.CANDIDATE, w)) if not any(m in v for v in values)]
            for s in [*values, *runs]:
                p = score(forest, features(s, w, before, after))
                if p > X.THRESHOLD:
                    out.append((i, k, len(s), hashlib.sha256(s.encode()).hexdigest(), round(p, 6)))
    return sorted(out)


def test_scan_word_by_word(spark):
    forest = X.forest_for(spark)
    rng = random.Random(8)
    letters = "abcdefXYZ0123456789+/_-.="
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = ["token", "=", "password:", "the", "commit", "secret=", "and", "id", "url:", "api_key", ":", "author:", "example", '"', "naïve"]
    docs = [(i, " ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(["", '"', "key="]) + made(rng.choice((7, 8, 15, 16, 17, 40))) + rng.choice(["", '"', ".", ","]) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(500 + r["id"], f"{r.before} {r.word} {r.after}") for r in X.labelled_findings(spark, X.TRAIN_ROWS + 400).where(F.col("id") >= X.TRAIN_ROWS).collect()]
    docs += [(9000, None), (9001, ""), (9002, " leading token = " + "a1B2" * 10 + " "), (9003, ("token=" + "Zx9" * 9 + " ") * 400)]
    got = X.scan(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string"), forest).collect()
    assert sorted((r.doc_id, r.word_at, r.n_chars, r.secret_sha256, r.score) for r in got) == scan(docs, forest)
    assert len(got) > 200
