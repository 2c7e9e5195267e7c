"""PII: format-preserving Feistel pseudonyms, in SQL expressions only.

Validated values are permuted by a keyed Feistel network within their own
format, so equal values get equal pseudonyms in every document and different
values different ones:

* payment cards (13 to 19 digits, Luhn): all digits but the last are permuted,
  the last is the new Luhn digit; IBANs (mod 97): the digits of the account
  part are permuted and the check digits set anew;
* US social security numbers, walked on until the number is a valid one again;
  telephone numbers, IPv4 addresses;
* dates (ISO, day first, or month first with slashes): the day number is
  permuted within a cycle of 400 years, 1800 to 2199, so a date becomes a date; where
  day or month is written with one digit, walked on until it has one again.

E-mail addresses have no digits to permute: their letters and digits are replaced by
a keyed digest in the form ``u<16 hex>@mail.invalid``.  Separators stay where they
are.  Numbers that fail validation are left alone.

A text is split at its matches and put together again, in place: no shuffle, no
row ever leaves its task.

Defined results: a null text stays null with no findings; texts of any length
are read whole; rows are judged alone, so ties, repeated rows and an empty table
need no rule; all other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEY = "quire pseudonym key"
ROUNDS = 8
#: Days of 400 Gregorian years; 627 x 233 of them, so two Feistel halves fit exactly.
FIRST_DAY, DAY_HALVES = "1800-01-01", (627, 233)

#: A domain has 127 labels at most; beyond that, what follows is not part of the address.
EMAIL = r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
ISO = r"(?<![\d./-])[12]\d{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d|-\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
DMY = r"(?<![\d./-])\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/|-\d{1,2}-)[12]\d{3}(?!\d|[./-]\d)"
PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d.-])"
)
ANY = "|".join((EMAIL, IBAN, IPV4, ISO, DMY, SSN, PHONE, CARD))
KINDS = ("email", "iban", "ipv4", "date", "ssn", "phone", "card")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _draw(key: str, tag: str, i: int, half: Column, mod: Column) -> Column:
    """A keyed number below ``mod``: 60 bits of SHA-256."""
    h = F.sha2(F.concat(F.lit(f"{key}|{tag}|{i}|"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), mod)


def feistel(a: Column, b: Column, a_mod: Column, b_mod: Column, tag: str, key: str, rounds: int = ROUNDS) -> tuple[Column, Column]:
    """Permutes the pairs (a, b) with a < a_mod and b < b_mod; each round adds a keyed number of the other half."""
    for i in range(rounds):
        if i % 2 == 0:
            a = F.pmod(a + _draw(key, tag, i, b, a_mod), a_mod)
        else:
            b = F.pmod(b + _draw(key, tag, i, a, b_mod), b_mod)
    return a, b


def unfeistel(a: Column, b: Column, a_mod: Column, b_mod: Column, tag: str, key: str, rounds: int = ROUNDS) -> tuple[Column, Column]:
    """The inverse permutation, for those who hold the key."""
    for i in reversed(range(rounds)):
        if i % 2 == 0:
            a = F.pmod(a - _draw(key, tag, i, b, a_mod), a_mod)
        else:
            b = F.pmod(b - _draw(key, tag, i, a, b_mod), b_mod)
    return a, b


def permute_pair(a: Column, b: Column, a_mod: int, b_mod: int, tag: str, key: str) -> Column:
    """The struct (a, b) of ``feistel``, each round evaluated once."""
    am, bm = F.lit(a_mod).cast("bigint"), F.lit(b_mod).cast("bigint")

    def one(i: int):
        def go(s: Column) -> Column:
            if i % 2 == 0:
                return F.struct(F.pmod(s["a"] + _draw(key, tag, i, s["b"], am), am).alias("a"), s["b"].alias("b"))
            return F.struct(s["a"].alias("a"), F.pmod(s["b"] + _draw(key, tag, i, s["a"], bm), bm).alias("b"))

        return go

    out = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    for i in range(ROUNDS):
        out = _step(out, one(i))
    return out


def walk(start: Column, fits, step, most: Column) -> Column:
    """``start`` after one ``step``, and after more until it ``fits``: a permutation of the values that fit."""
    return F.aggregate(F.sequence(F.lit(1), most), step(start), lambda x, _: F.when(fits(x), x).otherwise(step(x)))


def _step(column: Column, f) -> Column:
    """Evaluate ``column`` once, then ``f`` of it; nested rounds would else repeat it many times over."""
    return F.transform(F.array(column), f)[0]


def permute_digits(d: Column, tag: str, key: str, inverse: bool = False) -> Column:
    """A digit string of 2 to 18 digits to another of the same length."""
    n = F.length(d)
    left = F.floor(n / 2).cast("int")

    def ten(k: Column) -> Column:
        return F.pow(F.lit(10), k).cast("bigint")

    state = F.struct(
        d.substr(F.lit(1), left).cast("bigint").alias("a"), d.substr(left + 1, n).cast("bigint").alias("b"),
        ten(left).alias("am"), ten(n - left).alias("bm"), n.alias("n"), left.alias("l"),
    )

    def one(i: int):
        def go(s: Column) -> Column:
            sign = -1 if inverse else 1
            a, b = s["a"], s["b"]
            tagged = F.concat(F.lit(f"{tag}|"), s["n"].cast("string"))
            if i % 2 == 0:
                a = F.pmod(a + F.lit(sign) * _draw_col(key, tagged, i, b, s["am"]), s["am"])
            else:
                b = F.pmod(b + F.lit(sign) * _draw_col(key, tagged, i, a, s["bm"]), s["bm"])
            return F.struct(a.alias("a"), b.alias("b"), s["am"].alias("am"), s["bm"].alias("bm"), s["n"].alias("n"), s["l"].alias("l"))

        return go

    out = state
    order = range(ROUNDS)
    for i in reversed(order) if inverse else order:
        out = _step(out, one(i))
    return _step(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), s["l"], "0"), F.lpad(s["b"].cast("string"), s["n"] - s["l"], "0")))


def _draw_col(key: str, tag: Column, i: int, half: Column, mod: Column) -> Column:
    h = F.sha2(F.concat(F.lit(f"{key}|{i}|"), tag, F.lit("|"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), mod)


def refill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced, in order, by those of ``digits``."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(pattern)),
            lambda i: F.when(
                pattern.substr(i, F.lit(1)).rlike(r"\d"),
                digits.substr(F.length(_digits(pattern.substr(F.lit(1), i))), F.lit(1)),
            ).otherwise(pattern.substr(i, F.lit(1))),
        ),
        "",
    )


def _luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string, its last digit not doubled."""
    n = F.length(d)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when(F.pmod(n - i, F.lit(2)) == 0, d.substr(i, F.lit(1)).cast("int")).otherwise(
            F.pmod(d.substr(i, F.lit(1)).cast("int") * 2, F.lit(10)) + F.floor(d.substr(i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )


def luhn_ok(d: Column) -> Column:
    return F.pmod(_luhn_sum(d), F.lit(10)) == 0


def _card(m: Column, key: str) -> Column:
    def rebuilt(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return refill(m, F.concat(body, check.cast("string")))

    return _step(_step(_digits(m), lambda d: permute_digits(d.substr(F.lit(1), F.length(d) - 1), "card", key)), rebuilt)


def _mod97(s: Column) -> Column:
    """Remainder by 97 of a string whose letters count as 10 to 35."""
    return F.aggregate(
        F.split(s, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.rlike(r"\d"), F.pmod(acc * 10 + c.cast("int"), F.lit(97)))
        .otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))),
    )


def iban_ok(m: Column) -> Column:
    c = F.replace(m, F.lit(" "), F.lit(""))
    return (F.length(c) >= 15) & (F.length(c) <= 34) & (_mod97(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(1, 4))) == 1)


def _iban(m: Column, key: str) -> Column:
    def go(s: Column) -> Column:
        # Up to 30 digits: the first and the last 15 are permuted apart.
        d = _digits(s.substr(F.lit(5), F.length(s)))
        n = F.length(d)
        half = F.when(n > 18, F.floor(n / 2).cast("int")).otherwise(n)
        first = F.when(half > 1, permute_digits(d.substr(F.lit(1), half), "iban", key)).otherwise(d)
        rest = F.when(n > 18, permute_digits(d.substr(half + 1, n), "iban2", key)).otherwise(F.lit(""))
        body = refill(s.substr(F.lit(5), F.length(s)), F.concat(first, rest))
        return F.struct(s.alias("s"), body.alias("body"))

    def checked(x: Column) -> Column:
        land = x["s"].substr(1, 2)
        check = 98 - _mod97(F.concat(F.replace(x["body"], F.lit(" "), F.lit("")), land, F.lit("00")))
        return F.concat(land, F.lpad(check.cast("string"), 2, "0"), x["body"])

    return _step(_step(m, go), checked)


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))

    def go(p: Column) -> Column:
        return permute_pair(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ipv4", key)

    return _step(
        _step(parts, go),
        lambda s: F.concat_ws(
            ".", *[x.cast("string") for x in (F.shiftright(s["a"], 8), F.pmod(s["a"], F.lit(256)), F.shiftright(s["b"], 8), F.pmod(s["b"], F.lit(256)))]
        ),
    )


def _day(m: Column) -> Column:
    """The date of a match; null where there is no such day.  Slashes whose first number is a month and whose second exceeds 12 are read month first."""
    iso = F.to_date(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")))
    n = F.split(m, "[./-]")
    day, month = n[0], n[1]
    swap = m.contains("/") & (F.try_element_at(n, F.lit(2)).try_cast("int") > 12)
    text = F.concat_ws("-", F.try_element_at(n, F.lit(3)), F.lpad(F.when(swap, day).otherwise(month), 2, "0"), F.lpad(F.when(swap, month).otherwise(day), 2, "0"))
    return F.when(m.rlike(r"^\d{4}-"), iso).otherwise(F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def date_ok(m: Column) -> Column:
    return _day(m).between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date"))


def _date(m: Column, key: str) -> Column:
    x, y = DAY_HALVES
    first = F.lit(FIRST_DAY).cast("date")
    parts = lambda s: F.split(s, "[./-]")
    month_first = lambda s: s.contains("/") & (F.try_element_at(F.split(s, "/"), F.lit(2)).try_cast("int") > 12)
    wide = lambda s, i: (F.length(parts(s)[i]) > 1) | s.rlike(r"^\d{4}-")

    def moved(n: Column) -> Column:
        pair = permute_pair(F.floor(n / y), F.pmod(n, F.lit(y).cast("bigint")), x, y, "date", key)
        return _step(pair, lambda p: p["a"] * y + p["b"])

    def go(s: Column) -> Column:
        day_wide, month_wide = F.when(month_first(s), wide(s, 1)).otherwise(wide(s, 0)), F.when(month_first(s), wide(s, 0)).otherwise(wide(s, 1))

        def fits(n: Column) -> Column:
            d = F.date_add(first, n.cast("int"))
            return (day_wide | (F.dayofmonth(d) < 10)) & (month_wide | (F.month(d) < 10))

        start = F.datediff(_day(s), first).cast("bigint")
        n = walk(start, fits, moved, F.when(day_wide & month_wide, F.lit(1)).otherwise(F.lit(300)))
        return F.struct(s.alias("s"), F.date_add(first, n.cast("int")).alias("d"), day_wide.alias("dw"), month_wide.alias("mw"))

    def formed(v: Column) -> Column:
        s, d = v["s"], v["d"]
        sep = F.regexp_extract(s, r"\d([./-])", 1)
        dd, mm, yy = F.date_format(d, "dd"), F.date_format(d, "MM"), F.date_format(d, "yyyy")
        short = s.rlike(r"^\d{4}-")
        dd, mm = F.when(v["dw"] | short, dd).otherwise(F.date_format(d, "d")), F.when(v["mw"] | short, mm).otherwise(F.date_format(d, "M"))
        return F.when(s.rlike(r"^\d{4}-"), F.concat_ws("-", yy, mm, dd)).otherwise(
            F.concat(F.when(month_first(s), mm).otherwise(dd), sep, F.when(month_first(s), dd).otherwise(mm), sep, yy)
        )

    return _step(_step(m, go), formed)


def _number(m: Column, tag: str, key: str) -> Column:
    """All digits but the first permuted; the first may be a country code."""
    return _step(_digits(m), lambda d: refill(m, F.concat(d.substr(1, 1), permute_digits(d.substr(F.lit(2), F.length(d)), tag, key))))


def _ssn(m: Column, key: str) -> Column:
    valid = lambda d: ~d.rlike(r"^(?:000|666|9)|^\d{3}00|0000$")
    step = lambda d: F.concat(d.substr(1, 1), permute_digits(d.substr(F.lit(2), F.length(d)), "ssn", key))
    # One in 70 does not fit, so twelve more steps end all walks but one in 10**22.
    return _step(walk(_digits(m), valid, step, F.lit(12)), lambda d: refill(m, d))


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def classify(m: Column) -> Column:
    """The kind of a match, null where validation fails."""
    d = _digits(m)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), F.when(iban_ok(m), "iban"))
        .when(m.rlike(_full(IPV4)), "ipv4")
        .when(m.rlike(_full(ISO)) | m.rlike(_full(DMY)), F.when(date_ok(m), "date"))
        .when(m.rlike(_full(SSN)), "ssn")
        .when(m.rlike(_full(CARD)) & luhn_ok(d), "card")
        .when(m.rlike(_full(PHONE)) & F.length(d).between(8, 15), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    mail = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))
    return (
        F.when(kind == "email", mail)
        .when(kind == "iban", _iban(m, key))
        .when(kind == "ipv4", _ipv4(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "card", _card(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "phone", _number(m, "phone", key))
        .otherwise(m)
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("_k", lambda k: k == kind))


def pseudonymize(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with PII in ``text`` replaced, and ``n_<kind>`` counts of what was found."""
    some = F.col("text").rlike(ANY)
    found = docs.withColumn("_m", F.when(some, F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))))
    found = found.withColumn("_k", F.transform("_m", classify))
    swapped = F.zip_with("_m", "_k", lambda m, k: pseudonym(m, k, key))
    text = F.array_join(F.zip_with(F.split("text", ANY), swapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.col("_m").isNotNull(), text).otherwise(F.col("text"))
    counts = [F.when(F.col("_m").isNull(), F.lit(0)).otherwise(_count(n)).cast("int").alias(f"n_{n}") for n in KINDS]
    return found.select(*[F.col(c) for c in docs.columns if c != "text"], text.alias("text"), *counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
