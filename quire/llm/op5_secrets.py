"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``SHORTEST`` token characters within a word, of
whatever case; or a value of at least ``SHORTEST_VALUE`` characters that a key
word and ``=`` or ``:`` stand before (``password: ...``, ``token=...``).
The forest sees its length, its character transitions (changes between lower
case, upper case, digits and signs), the share of digits and of hexadecimal
characters, how much of it a dictionary of common fragments covers, whether it
looks like a path, placeholder words, and the words before and after it.

It is trained from labelled findings, made by rule from row numbers
(``labelled_findings``; ``TRAIN_ROWS`` of them, a fixed bound): random
hexadecimal, base-64, one-case and prefixed keys and short passwords beside key
words on one side; long words, identifiers, paths, addresses, placeholders,
checksums, commit ids and plain words after a key word on the other.  The trees
become SQL expressions, so that candidates are scored where they are found: no
shuffle, no join, nothing outside whole-row expressions.

Defined results: null and empty texts have no findings; texts are read whole
and every candidate in them is scored; repeated rows each give their findings;
an empty table gives none; other columns are ignored, and kept by ``redact``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

SHORTEST, SHORTEST_VALUE = 16, 8
#: Padding belongs to a candidate at its end only, so that ``key=value`` is two runs; a full stop ends a sentence.
CANDIDATE = (
    rf"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{{{SHORTEST - 1},}}[A-Za-z0-9+/_-](?:==?(?![A-Za-z0-9+/_.=-]))?"
)
TRAIN_ROWS = 6000
TREES, DEPTH, SEED = 15, 6, 7
THRESHOLD = 0.5
MASK = "[SECRET]"

# Common fragments of words, and words that stand near secrets or near examples.
FRAGMENTS = (
    "tion ment ness able ible ing the and ent ith for ous est ers ter ver con pro com per ion ate ess ist "
    "ein sch ung lich keit heit eau eux que les aux cion mente ado ando iento user file name data list item "
    "page test main index config home http www html docs lib src bin usr local version build release"
).split()
NEAR_SECRET = "token|secret|passw|pwd|api.?key|apikey|access.?key|auth(?!or)|bearer|credential|private"
NEAR_OTHER = "sha1|sha256|md5|checksum|digest|commit|revision|etag|uuid|hash|build|version|integrity"
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234567|test"

#: Group 1 is the value; the rest of the key's name may have up to 40 characters.
BESIDE = (
    rf"(?i:{NEAR_SECRET})[\w.-]{{0,40}}[\"'`]?\s*+[=:]>?\s*+[\"'`]?"
    rf"([A-Za-z0-9!#$%&*+./?@^_~-]{{{SHORTEST_VALUE - 1},}}[A-Za-z0-9!#$%&*+/@^_~-]={{0,2}})"
)

#: What ``BESIDE`` needs at least; quick to look for.
SIGN = rf"[=:]>?\s*+[\"'`]?[A-Za-z0-9!#$%&*+./?@^_~-]{{{SHORTEST_VALUE}}}"

FEATURES = (
    "length transitions digits hexadecimal upper dictionary distinct vowels path near_secret near_other placeholder assigned quoted"
).split()


def _share(s: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(s, keep, "")) / F.length(s)


def features(s: Column, word: Column, before: Column, after: Column) -> dict[str, Column]:
    """The forest's inputs for candidate ``s`` within ``word``, with its neighbours."""
    runs = sum(F.regexp_count(s, F.lit(p)) for p in ("[a-z]+", "[A-Z]+", "[0-9]+", "[^A-Za-z0-9]+"))
    around = F.lower(F.concat_ws(" ", before, word, after))
    ahead = F.lower(F.concat_ws(" ", before, F.replace(word, s, F.lit(" "))))
    low = F.lower(s)

    def yes(c: Column) -> Column:
        return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))

    return {
        "length": F.length(s).cast("double"),
        "transitions": (runs - 1) / F.length(s),
        "digits": _share(s, "[^0-9]"),
        "hexadecimal": _share(s, "[^0-9a-fA-F]"),
        "upper": _share(s, "[^A-Z]"),
        "dictionary": F.lit(1.0) - _share(low, "|".join(FRAGMENTS)),
        "distinct": F.size(F.array_distinct(F.split(s, ""))) / F.least(F.length(s), F.lit(64)),
        "vowels": _share(low, "[^aeiouy]"),
        "path": F.regexp_count(word, F.lit("[/.]")).cast("double"),
        "near_secret": yes(ahead.rlike(NEAR_SECRET)),
        "near_other": yes(ahead.rlike(NEAR_OTHER)),
        "placeholder": yes(around.rlike(PLACEHOLDER)),
        "assigned": yes(F.concat_ws(" ", before, F.call_function("substring_index", word, s, F.lit(1))).rlike(r"[=:]>?\s*[\"'`]?$")),
        "quoted": yes(word.rlike("[\"'`]")),
    }


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """``s, before, after, label`` made from row numbers by SHA-256; half of them secrets."""
    h = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256)
    g = F.sha2(F.concat(F.lit("more "), F.col("id").cast("string")), 512)

    def pick(words: str, at: int) -> Column:
        options = words.split("|")
        n = F.pmod(F.conv(F.substring(h, at, 6), 16, 10).cast("int"), F.lit(len(options))) + 1
        return F.element_at(F.array(*[F.lit(x) for x in options]), n)

    def some(low: int, high: int, at: int) -> Column:
        return F.pmod(F.conv(F.substring(h, at, 6), 16, 10).cast("int"), F.lit(high - low + 1)) + low

    b64 = F.regexp_replace(F.base64(F.unhex(g)), "[+/=]", "_")
    prose = F.array_join(F.transform(F.sequence(F.lit(0), some(3, 8, 9) - 1), lambda i: F.element_at(
        F.array(*[F.lit(x) for x in FRAGMENTS]), F.pmod(F.conv(F.substring(g, i * 5 + 1, 5), 16, 10).cast("int"), F.lit(len(FRAGMENTS))) + 1)), "")
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    path = F.concat(F.lit("/"), F.regexp_replace(prose, "(.{5})", "$1/"), some(1, 999, 15).cast("string"))
    mail = F.concat(F.regexp_replace(prose, "(.{6})", "$1."), some(1, 99, 15).cast("string"))
    assign = pick("token =|token:|api_key =|secret =|password:|access_key =|auth token =|client_secret :|bearer|export API_KEY=|Authorization: Bearer|pwd =", 40)
    other = pick("commit|sha256:|md5 =|checksum:|revision|etag:|uuid =|build|see|the file|integrity =|id =|path =|url:", 40)
    prior = pick("the|with|and|of|per|el|und|les|mit|is", 46)
    letters = F.regexp_replace(F.lower(F.base64(F.unhex(g))), "[^a-z]", "")
    syllables = F.concat(*[F.concat(pick("b|d|f|g|k|l|m|n|p|r|s|t|v|w", 2 * i + 1), pick("a|e|i|o|u|ei|au", 2 * i + 2)) for i in range(8)])
    sign = pick("!|$|#|@|%|&|*", 21)
    number = some(1, 9999, 24).cast("string")
    one_of_two = F.pmod(F.conv(F.substring(h, 58, 4), 16, 10).cast("int"), F.lit(2)) == 0
    kind = F.pmod("id", F.lit(24))
    case = F.pmod(F.conv(F.substring(h, 44, 4), 16, 10).cast("int"), F.lit(3))

    def cased(c: Column) -> Column:
        return F.when(case == 0, F.initcap(c)).when(case == 1, F.upper(c)).otherwise(c)

    secret = (kind < 8) | kind.between(16, 19)
    s = (
        F.when(kind == 0, F.substring(g, 1, 40)).when(kind == 1, F.substring(g, 1, 32)).when(kind == 2, F.substring(g, 1, 64))
        .when(kind == 3, b64.substr(F.lit(1), some(20, 60, 20))).when(kind == 4, b64.substr(F.lit(1), some(20, 44, 20)))
        .when(kind == 5, F.concat(pick("AKIA|ASIA", 30), F.upper(F.substring(b64, 3, 16))))
        .when(kind == 6, F.concat(pick("ghp_|sk_live_|xoxb-|glpat-|pk_|npm_", 30), F.substring(b64, 1, 36)))
        .when(kind == 7, F.substring(g, 1, 40))
        .when(kind == 8, cased(prose)).when(kind == 9, F.concat(prose, F.lit("."), F.reverse(prose)))
        .when(kind == 10, path).when(kind == 11, uuid).when(kind == 12, F.substring(g, 1, 40))
        .when(kind == 13, F.concat(pick("your-|example-|dummy_|xxxxxxxxxxxx|test_|changeme-", 30), prose, F.lit("-"), F.substring(g, 1, 4)))
        .when(kind == 14, mail).when(kind == 15, F.concat(F.substring(g, 1, 1), F.lpad(some(0, 999999, 33).cast("string"), 15, "0")))
        .when((kind == 16) & one_of_two, F.concat(F.substring(b64, 1, 4), sign, F.substring(b64, 5, 7))).when(kind == 16, F.concat(F.initcap(F.substring(prose, 1, 7)), number, sign))
        .when(kind == 17, F.when(one_of_two, letters).otherwise(F.upper(letters)).substr(F.lit(1), some(16, 36, 20)))
        .when(kind == 18, b64.substr(F.lit(1), some(8, 15, 20))).when(kind == 19, F.substring(g, 1, 40))
        .when(kind == 20, F.when(one_of_two, prose).otherwise(syllables).substr(F.lit(1), some(8, 14, 20))).when(kind == 21, F.substring(g, 1, 40))
        .when(kind == 22, F.concat(pick("your_|example_|dummy-|xxxx|test_|changeme|sample", 30), F.substring(prose, 1, 6)))
        .otherwise(cased(F.when(one_of_two, letters).otherwise(syllables)).substr(F.lit(1), some(16, 28, 20)))
    )
    before = F.when(secret | kind.isin(20, 22), F.concat_ws(" ", prior, assign)).when(kind == 13, F.concat_ws(" ", prior, assign)).when(
        F.pmod(F.conv(F.substring(h, 52, 4), 16, 10).cast("int"), F.lit(2)) == 0, F.concat_ws(" ", prior, other)
    ).otherwise(F.concat_ws(" ", prior, prior))
    # Keys that show what they are by their first letters also stand alone.
    before = F.when(kind.isin(5, 6) & (F.pmod(F.conv(F.substring(h, 60, 4), 16, 10).cast("int"), F.lit(2)) == 0), F.concat_ws(" ", prior, prior)).otherwise(before)
    # Long numbers and addresses in prose have no key word at all.
    before = F.when(kind.isin(14, 15, 23), F.concat_ws(" ", prior, prior)).otherwise(before)
    quote = F.when(F.pmod(F.conv(F.substring(h, 56, 4), 16, 10).cast("int"), F.lit(2)) == 0, F.lit('"')).otherwise(F.lit(""))
    # Keys and values of one word, with nothing between them but a sign.
    own = F.when(secret, pick("token=|api_key=|secret=|password=|client_secret:|API_KEY=|access_key=", 36)).otherwise(pick("id=|commit=|etag=|sha1:|revision=|path=|hash=", 36))
    joined = kind.isin(19, 21) | (kind.isin(3, 16, 17, 18) & one_of_two)
    word = F.concat(F.when(joined, own).otherwise(F.lit("")), quote, s, quote)
    before = F.when(joined, F.concat_ws(" ", prior, prior)).otherwise(before)
    return spark.range(0, rows, 1, 4).select(
        s.alias("s"), word.alias("word"), before.alias("before"), prior.alias("after"), secret.cast("double").alias("label"), "id"
    )


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list:
    """Fit the forest; each tree as nested tuples ``(feature, threshold, left, right)`` or a leaf's share of secrets."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    f = features(F.col("s"), F.col("word"), F.col("before"), F.col("after"))
    # Written first: the learner passes over its rows many times.
    rows = stage(stage(findings, "findings").select(*[c.cast("double").alias(n) for n, c in f.items()], "label"), "findings-features")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(rows)

    def walk(node):
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            return float(stats[1] / sum(stats))
        split = node.split()
        return FEATURES[split.featureIndex()], float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t.rootNode()) for t in forest._java_obj.trees()]


@lru_cache(maxsize=4)
def _trained(app: str, rows: int) -> tuple:
    spark = SparkSession.active()
    return tuple(train(labelled_findings(spark, rows)))


def forest_for(spark: SparkSession) -> tuple:
    return _trained(spark.sparkContext.applicationId, TRAIN_ROWS)


def score(forest, x: Column) -> Column:
    """Mean share of secrets over the trees, for a struct ``x`` of features.

    The struct is bound once: each tree node names it, none repeats how it is made.
    """

    def tree(node, v: Column) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, at, left, right = node
        return F.when(v[name] <= at, tree(left, v)).otherwise(tree(right, v))

    def total(v: Column) -> Column:
        out = tree(forest[0], v)
        for t in forest[1:]:
            out = out + tree(t, v)
        return out / len(forest)

    return F.transform(F.array(x), total)[0]


def _has_value(text: Column) -> Column:
    return text.rlike(SIGN) & text.rlike(BESIDE)


def _scored(text: Column, forest) -> Column:
    """Array of ``(word_at, secret, score)`` for every candidate of a text."""
    bound = F.struct(F.split(text, r"[\x20\x09-\x0D]+").alias("ws"), _has_value(text).alias("beside"))

    def of(b: Column) -> Column:
        ws = b["ws"]

        def joined(i: Column) -> Column:
            return F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1), F.get(ws, i))

        spots = F.filter(
            F.sequence(F.lit(0), F.size(ws) - 1),
            lambda i: F.get(ws, i).rlike(CANDIDATE) | (b["beside"] & joined(i).rlike(BESIDE)),
        )

        def at(i: Column) -> Column:
            w = F.get(ws, i)
            before = F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1))
            after = F.concat_ws(" ", F.get(ws, i + 1))
            runs = F.regexp_extract_all(w, F.lit(f"({CANDIDATE})"), F.lit(1))
            values = F.filter(F.regexp_extract_all(joined(i), F.lit(BESIDE), F.lit(1)), lambda s: F.contains(w, s))
            # A run within a value is part of it.
            found = F.array_union(values, F.filter(runs, lambda s: ~F.exists(values, lambda v: F.contains(v, s))))

            def judged(s: Column) -> Column:
                x = F.struct(*[c.cast("double").alias(n) for n, c in features(s, w, before, after).items()])
                return F.struct(i.alias("word_at"), s.alias("secret"), score(forest, x).alias("score"))

            return F.transform(found, judged)

        return F.flatten(F.transform(spots, at))

    return F.transform(F.array(bound), of)[0]


def candidates(docs: DataFrame, forest=None) -> DataFrame:
    """``docs`` with ``_found``: the scored candidates, null where a text has none at all."""
    forest = forest or forest_for(docs.sparkSession)
    return docs.withColumn("_found", F.when(F.col("text").rlike(CANDIDATE) | _has_value(F.col("text")), _scored(F.col("text"), forest)))


def scan(docs: DataFrame, forest=None) -> DataFrame:
    """``doc_id, word_at, n_chars, secret_sha256, score`` of each finding that the forest keeps."""
    rows = candidates(docs.select("doc_id", "text"), forest).select("doc_id", F.explode("_found").alias("f"))
    return rows.where(F.col("f.score") > THRESHOLD).select(
        "doc_id",
        F.col("f.word_at").alias("word_at"),
        F.length("f.secret").alias("n_chars"),
        F.sha2("f.secret", 256).alias("secret_sha256"),
        F.round("f.score", 6).alias("score"),
    )


def redact(docs: DataFrame, forest=None) -> DataFrame:
    """``docs``, all its columns and rows, with found secrets replaced by ``MASK``; ``n_chars`` follows the text."""
    found = candidates(docs, forest)
    bad = F.filter("_found", lambda f: f["score"] > THRESHOLD)
    # Longer secrets first, so that one that is part of another leaves no rest.
    ordered = F.transform(F.array_sort(F.transform(bad, lambda f: F.struct((-F.length(f["secret"])).alias("n"), f["secret"].alias("s")))), lambda x: x["s"])
    text = F.when(F.size(bad) > 0, F.aggregate(ordered, F.col("text"), lambda t, s: F.replace(t, s, F.lit(MASK)))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(bad) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
