"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each URL expands into (host suffix, path prefix) expressions.  Path prefixes are
cut only at the lengths that occur in the rules, host suffixes only at the numbers of
labels that occur there, so the expansion of a URL is bounded by the rules whatever it is.  Expressions
meet the rules in an equi-join on the first 32 bits of SHA-256; a join row
counts only if the full digests agree.  The longest rule wins; of equally long
ones that with the longer host, then a block.

Defined results: a null URL or one without ``://`` has an empty host and path
and fits no rule; repeated rows each give a row; an empty rule or page table
gives no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many rows are broadcast (about 120 bytes each); larger lists are joined by shuffle.
BROADCAST_RULES = 50_000
DEFAULT_VERDICT = "allow"

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = _lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules or [("", "", "")], "rule_host string, rule_path string, rule_verdict string").where(
        F.lit(bool(rules))
    )


def _digest(host: Column, path: Column) -> Column:
    # A byte that no host holds keeps (a, bc) and (ab, c) apart.
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``."""
    r = rules.select(
        _lower_ascii(F.col("rule_host")).alias("rule_host"), "rule_path", "rule_verdict",
    ).withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path")))
    r = r.withColumn("short", F.substring("rule_digest", 1, 8))
    sized = r.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lens"), F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels")).first()
    lens = [int(x) for x in sized["lens"]] or [0]
    if sized["n"] <= BROADCAST_RULES:
        r = F.broadcast(r)

    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_col), F.col("url")).select(F.col(id_col), host.alias("host"), path.alias("path"))
    # Rows of one page stay in one task until the aggregate, so the row number is only a local name.
    base = base.withColumn("_row", F.monotonically_increasing_id())
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*[F.when(dots >= n, F.substring_index("host", ".", -int(n))) for n in sized["labels"] or [1]]))
    cuts = F.filter(F.array(*[F.lit(x) for x in lens]), lambda n: n <= F.length("path"))
    many = base.withColumn("suffix", F.explode_outer(suffixes)).withColumn("cut", F.explode_outer(cuts))
    many = many.withColumn("prefix", F.expr("substring(path, 1, cut)"))
    many = many.withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
    hits = many.join(r, F.substring("digest", 1, 8) == r["short"], "left")
    sure = (F.col("digest") == F.col("rule_digest")) & (F.col("host") != "")
    rank = F.when(
        sure,
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("n"),
            F.length("rule_host").alias("h"),
            (F.col("rule_verdict") == "block").alias("b"),
            F.concat("rule_host", "rule_path").alias("rule"),
            F.col("rule_verdict").alias("verdict"),
        ),
    )
    best = hits.groupBy("_row", id_col, "host", "path").agg(F.max(rank).alias("best"))
    return best.select(
        id_col,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


SQL = """
WITH rules(rh, rp, v) AS (VALUES ('com','/en/','block'),('example.com','/en/7','allow'),('net','/de/','allow'),
                                 ('example.net','/de/8','block'),('org','/es/','block')),
rest AS (SELECT page_id, row_number() OVER () AS rn,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, rn, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT rn, rh || rp AS rule, v,
                row_number() OVER (PARTITION BY rn ORDER BY length(rh || rp) DESC, length(rh) DESC, v DESC) AS k
         FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (rn)
"""
