"""Sharding, PII, secrets, WARC and URL filters."""

import hashlib
import random
import re
import zlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from quire.llm import op1_sharding as S
from quire.llm import op3_pii as P
from quire.llm import op5_secrets as X
from quire.llm import op7_warc as W
from quire.llm import op8_url_filters as U
from tests.llm.test_text_ops import docs

# ---------------------------------------------------------------- sharding


def minimax(sizes, shards):
    def fits(c):
        n, at = 1, 0
        for x in sizes:
            if at + x > c:
                n, at = n + 1, 0
            at += x
        return n <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("finish", [50_000, 3])
def test_shards_are_minimax_and_groups_atomic(spark, monkeypatch, finish):
    monkeypatch.setattr(S, "FINISH_ROWS", finish)
    rng = random.Random(1)
    texts = [None, None, "", "hot" * 9] + ["hot" * 9] * 40 + ["x" * rng.randint(0, 80) + str(rng.randint(0, 99)) for _ in range(150)]
    rows = S.shard(docs(spark, texts), 5).collect()
    assert len(rows) == len(texts)
    total, place = {}, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
        total[r.shard] = total.get(r.shard, 0) + r["size"]
    for k in total:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    groups = {}
    for t in texts:
        h = hashlib.sha256(t.encode()).hexdigest() if t is not None else "null"
        groups[h] = groups.get(h, 0) + len((t or "").encode()) + 1
    order = sorted(groups, key=lambda h: ((int(h[:4], 16) % S.BUCKETS) if h != "null" else 0, h))
    assert max(total.values()) == minimax([groups[h] for h in order], 5)


def test_shards_of_little(spark):
    assert S.shard(docs(spark, [])).count() == 0
    assert {(r.shard, r.slot) for r in S.shard(docs(spark, ["a", "a"], [1, 1])).collect()} == {(0, 0), (0, 1)}


# ---------------------------------------------------------------- PII


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def iban97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_pseudonyms_keep_format_and_links(spark):
    texts = [
        "4845168114407329 then 4845-1681-1440-7329 and 9807915762804490", "a.b+c@x.example.com; Ünd.4@m.example.de.", "ip 97.51.17.173 not 256.1.1.1 nor 1.2.3.4.5",
        "+1 (017) 555-7713 (212) 555-0199 212-555-0199", "2024-02-29 2023-02-30 31.12.1999 12/25/2001", "DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00", "123-45-6789 000-12-3456",
    ] + [None, "", "plain", "4845168114407329" + " x" * 5000]
    rows = {r.doc_id: r for r in P.pseudonymize(docs(spark, texts)).collect()}
    t = {i: r.text for i, r in rows.items()}
    a, b, c = re.findall(r"[\d-]{16,}", t[0])
    assert a != "4845168114407329" and luhn(a) and b.replace("-", "") == a and b.count("-") == 3 and c == "9807915762804490"
    assert t[10].startswith(a + " x")
    assert "example" not in t[1] and t[1].count("@mail.invalid") == 2
    ip = re.match(r"ip ([\d.]+) not 256.1.1.1 nor 1.2.3.4.5$", t[2])[1]
    assert ip != "97.51.17.173" and all(int(x) < 256 for x in ip.split("."))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \(2\d\d\) \d{3}-\d{4} 2\d\d-\d{3}-\d{4}", t[3]) and "555-7713" not in t[3]
    d = t[4].split(" ")
    assert d[1] == "2023-02-30" and date.fromisoformat(d[0]) and re.fullmatch(r"\d\d\.\d\d\.\d{4}", d[2]) and d[0] != "2024-02-29"
    good, bad = t[5].split(" and ")
    assert iban97(good) and good.startswith("DE") and good != texts[5].split(" and ")[0] and bad == "DE88 3704 0044 0532 0130 00"
    assert t[6].endswith("000-12-3456") and not t[6].startswith("123-45")
    assert (t[7], t[8], t[9]) == (None, "", "plain") and rows[0].n_card == 2 and rows[4].n_date == 3
    assert {"kind", "n"} <= set(P.pseudonymize(docs(spark, [])).columns)


def test_valid_numbers_stay_valid_and_different(spark):
    ids = [f"{a:03d}-{g:02d}-{n:04d}" for a in range(1, 900, 7) if a != 666 for g in (1, 45, 99) for n in (1, 777, 9999)]
    got = [r.text for r in P.pseudonymize(docs(spark, ids)).collect()]
    assert all(re.fullmatch(P.SSN, x) for x in got) and len(set(got)) == len(ids)
    short = [f"{d}.{m}.{y}" for d in (1, 5, 9) for m in (1, 4, 9) for y in range(1990, 2010)]
    got = [r.text for r in P.pseudonymize(docs(spark, short)).collect()]
    assert all(re.fullmatch(r"[1-9]\.[1-9]\.\d{4}", x) for x in got) and len(set(got)) == len(short)
    same = [r.text for r in P.pseudonymize(docs(spark, ["2020-11-30", "30.11.2020", "11/30/2020"])).collect()]
    assert same[0] == "-".join(reversed(same[1].split("."))) and sorted(same[2].split("/")) == sorted(same[0].split("-"))


def test_pseudonyms_equal_an_independent_feistel(spark):
    """SSN and IPv4 by plain Python."""
    import hashlib

    draw = lambda text, mod: int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % mod

    def digits(d, tag, key):
        n, k = len(d), len(d) // 2
        a, b, am, bm = int(d[:k]), int(d[k:]), 10**k, 10 ** (n - k)
        for i in range(8):
            if i % 2 == 0:
                a = (a + draw(f"{key}|{i}|{tag}|{n}|{b}", am)) % am
            else:
                b = (b + draw(f"{key}|{i}|{tag}|{n}|{a}", bm)) % bm
        return f"{a:0{k}d}{b:0{n - k}d}"

    def ssn(x, key):
        d = x.replace("-", "")
        while True:
            d = d[0] + digits(d[1:], "ssn", key)
            if not re.search(r"^(000|666|9)|^\d{3}00|0000$", d):
                return f"{d[:3]}-{d[3:5]}-{d[5:]}"

    def ipv4(x, key):
        p = list(map(int, x.split(".")))
        a, b = p[0] * 256 + p[1], p[2] * 256 + p[3]
        for i in range(8):
            if i % 2 == 0:
                a = (a + draw(f"{key}|ipv4|{i}|{b}", 65536)) % 65536
            else:
                b = (b + draw(f"{key}|ipv4|{i}|{a}", 65536)) % 65536
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"

    values = [f"{100 + i}-45-{6000 + i}" for i in range(60)] + [f"10.{i}.3.{i}" for i in range(40)]
    got = {r.doc_id: r.text for r in P.pseudonymize(docs(spark, values), key="k").collect()}
    assert [got[i] for i in range(100)] == [ssn(x, "k") if "-" in x else ipv4(x, "k") for x in values]


def test_very_long_domains_and_texts(spark):
    texts = ["mail x@" + "a." * 20_000 + "end", "mail x@" + "abc." * 20_000 + "end", "1" * 200_000, "7" + " 7" * 100_000]
    rows = {r.doc_id: r for r in P.pseudonymize(docs(spark, texts)).collect()}
    assert rows[0].text == texts[0] and rows[1].n_email == 1 and rows[2].text == texts[2]


def test_digit_permutation_is_one(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    e = d.withColumn("e", P.permute_digits(F.col("d"), "t", "key"))
    assert e.select("e").distinct().count() == 1000 and e.where("length(e) <> 3").count() == 0
    assert e.withColumn("f", P.permute_digits(F.col("e"), "t", "key", inverse=True)).where("f <> d").count() == 0
    k = F.lit(233).cast("bigint")
    a, b = P.feistel(F.col("id") % 627, F.col("id") % 233, F.lit(627).cast("bigint"), k, "x", "key")
    pair = spark.range(500).select("id", a.alias("a"), b.alias("b"))
    x, y = P.unfeistel(F.col("a"), F.col("b"), F.lit(627).cast("bigint"), k, "x", "key")
    assert pair.select("id", x.alias("x"), y.alias("y")).where("x <> id % 627 or y <> id % 233").count() == 0


# ---------------------------------------------------------------- secrets


def test_forest_on_held_out_findings(spark):
    forest = X.forest_for(spark)
    held = X.labelled_findings(spark, X.TRAIN_ROWS + 1500).where(F.col("id") >= X.TRAIN_ROWS)
    f = X.features(F.col("s"), F.col("word"), F.col("before"), F.col("after"))
    p = held.select("label", X.score(forest, F.struct(*[c.cast("double").alias(n) for n, c in f.items()])).alias("p"))
    assert p.where((F.col("p") > X.THRESHOLD) == (F.col("label") == 1)).count() >= 0.97 * 1500


def test_secrets_are_found_and_masked(spark):
    key = hashlib.sha1(b"k").hexdigest()
    texts = [f'x token = "{key}" y', f"commit {key} is fine", "mail someone.long.name99@mail7.example.com", None, "", f'password="{key}"' + " w" * 4000, "see /usr/local/lib/python3.11/site.py", "token = " + "qwhzkdjrvbxnmwpltgcfyska", "9807915762804490",
             "password = hunter2XyZ9! yes", f"a token={key} b", "the password: required by all", f"id={key}", 'pwd="aB3$kk91"', "author: Wilhelmina", "Donaudampfschifffahrtsgesellschaft", "secret: P@ss-w0rd-long-value!77",
             f"token: {key}.", "internationalization and Unwahrscheinlichkeit", "token" * 300 + " " * 300 + "= x"]
    frame = docs(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    assert {(r.doc_id, r.word_at, r.n_chars) for r in X.scan(frame).collect()} == {
        (0, 3, 40), (5, 0, 40), (7, 2, 24), (9, 2, 12), (10, 1, 40), (13, 0, 8), (16, 1, 23), (17, 1, 40)}
    out = {r.doc_id: r for r in X.redact(frame).collect()}
    assert out[0].text == 'x token = "[SECRET]" y' and out[0].n_chars == 22 and key not in out[5].text
    assert all(out[i].text == texts[i] for i in (1, 2, 3, 4, 6, 8, 11, 12, 14, 15, 18, 19)) and out[10].text == "a token=[SECRET] b" and X.redact(frame).columns == frame.columns
    assert X.scan(docs(spark, [])).count() == 0 and X.scan(docs(spark, [texts[0]] * 2, [1, 1])).count() == 2


# ---------------------------------------------------------------- WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def warc_truth(rows):
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    out = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= W.LEAST and first[h] != i
        out.add((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return out


NEST = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("split", [None, "300"])
def test_magic_inside_payloads(spark, tmp_path, split):
    rows = [(1, "u", "<p>" + NEST + "é" * 30), (2, "u", NEST * 5), (3, None, None), (4, "u", "x" * 200), (5, "u\r\nv", "x" * 200), (6, "u", "WARC/1.0"), (7, "u", NEST[:-8]), (8, "u", "z" * 150 + "WARC/1."),
            (9, "u", "WARC/1.WARC/1.1\r\nContent-Length: 99999\r\n\r\n"), (10, "u", "small"), (11, "u", "small"), (12, "u", "")]
    path = str(tmp_path / "warc")
    W.write_archive(pages(spark, rows).coalesce(2), path)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [tuple(r) for r in W.read_archive(spark, path).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(rows) and set(got) == warc_truth(rows)


def test_archive_of_nothing_and_hot_payloads(spark, tmp_path):
    W.write_archive(pages(spark, []), str(tmp_path / "a"))
    assert W.read_archive(spark, str(tmp_path / "a")).count() == 0
    rows = [(i, "u", "y" * 120) for i in range(50)] + [(50 + i, "u", f"page {i}") for i in range(20)]
    W.write_archive(pages(spark, rows).repartition(3), str(tmp_path / "b"))
    assert {tuple(r) for r in W.read_archive(spark, str(tmp_path / "b")).collect()} == warc_truth(rows)


def test_bytes_behind_a_broken_chain_are_left_out(spark, tmp_path):
    good = NEST.replace("page:77", "page:1")
    (tmp_path / "f.warc").write_bytes((good + "junk " + NEST).encode())
    assert [r.page_id for r in W.read_archive(spark, str(tmp_path)).collect()] == [1]


# ---------------------------------------------------------------- URL filters


def test_pages_without_id_lose_no_record(spark, tmp_path):
    body = "<p>" + "z" * 200
    pages = spark.createDataFrame([(1, "u", body), (None, "u", body), (None, None, "other " * 40), (4, "u", body), (5, "u", None)], "page_id long, url string, html string").coalesce(1)
    W.write_archive(pages, str(tmp_path / "w"))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.read_archive(spark, str(tmp_path / "w")).collect()]
    want = [(1, "response", None, 203), (None, "response", None, 203), (None, "response", None, 240), (4, "revisit", 1, 203), (5, "response", None, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_very_long_hosts_and_paths(spark):
    urls = ["http://" + "a." * 30_000 + "example.com/en/7" + "x" * 100_000, "http://" + "a" * 100_000 + ".net/de/9"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(pages, U.rule_table(spark, U.RULES)).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("net/de/", "allow")}


def test_rules_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "Example.COM", "com", "x.net", "example.net", "deep.er.example.net", "y.org", "notexample.com", "example.community"]
    urls = [None, "", "no scheme", "http://", "http://com/en/", "://com/en/x?y", "http://EXAMPLE.com/EN/7"] + [
        f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.choice('78')}{rng.choice(['', '1', '/x?q=/de/8', '#top'])}" for _ in range(150)]
    frame = spark.createDataFrame([(i % 100, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")

    def judge(u):
        rest = u[u.index("://") + 3 :] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        return host, path, best[3], best[4]

    want = [(i % 100, *judge(u)) for i, u in enumerate(urls)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in U.judge_urls(frame, U.rule_table(spark, U.RULES)).collect()), key=key) == sorted(want, key=key)
    none = U.judge_urls(frame, U.rule_table(spark, []))
    assert none.count() == len(urls) and none.where("rule is not null or verdict <> 'allow'").count() == 0
    assert U.judge_urls(frame.where("false"), U.rule_table(spark, U.RULES)).count() == 0
