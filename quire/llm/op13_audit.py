"""Filter interaction audit: what each filter removes, repeats and costs, in every order of application.

Five filters fail documents: ``A`` under 50 words, ``B`` few distinct words,
``C`` many capitals, ``D`` markup signs, ``E`` an exact copy of a text with a
smaller doc_id anywhere in the table.  A document's failures are a mask of
five bits, and every figure of the audit follows from how many documents of a
part have each mask.  So documents are counted to mask cells first, with
partial aggregation before every shuffle, and only cells are unpivoted against
the steps of all 120 orders.  Over each (part, order, cell), in step order, a
running bit-or tells which filters have failed the cell before; conditional
sums give the metrics of a step, and a window over a part's filter the total
of its removals over all orders.

Whether a text is a copy is told without a join of texts: copies of a text in
a part are one row, with its smallest doc_id and how many rows have that id;
texts travel as SHA-256 digests only.

Defined results: null texts count as empty; a null doc_id is smaller than
none and none is smaller than it, so such rows are no copies, make none, and
have no labels; rows of one doc_id and one text are no copies of each other;
of several labels of a doc_id, 1 counts; a null source is the part "";
labels of unknown documents are ignored; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 50, 65, 5
SIGNS = "[#$%&*|]"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    bound = F.struct(text.alias("t"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("ws"))

    def mask(b: Column) -> Column:
        n, capitals = F.size(b["ws"]), F.length(b["t"]) - F.length(F.regexp_replace(b["t"], "[A-Z]", ""))
        fails = (
            n < MIN_WORDS,
            F.size(F.array_distinct(b["ws"])).cast("long") * 100 < n * MIN_DISTINCT_PCT,
            capitals.cast("long") * 100 > F.length(b["t"]) * MAX_CAPITALS_PCT,
            b["t"].rlike(SIGNS),
        )
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return F.transform(F.array(bound), mask)[0]


def _counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``digest, part, mask, good, toxic, doc_id`` with ``n``, the rows that agree in all of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask"))
    # Rows without an id are spread by their digest; none of them has labels.
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")).select(
        "*", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.xxhash64("digest")).alias("key"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    ).withColumn("no_id", F.lit(False))
    return rows.join(marks, ["no_id", "key"], "left").select(
        "doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, n_good, n_toxic``: documents by part and mask of failures, E being bit 16."""
    kinds = ["part", "digest", "mask", "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    # Rows of the smallest id may be several; they are counted already, so it is one row here.
    group = _counted(docs, labels).groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id"), first.alias("first"))
    group = group.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    group = group.withColumn("fresh", F.col("n_no_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    cells = group.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0)")).alias("n_good"), F.sum(F.expr("if(toxic, n, 0)")).alias("n_toxic"))


def steps(filters: str = FILTERS) -> list[tuple[str, int, int]]:
    """``(order, step, bit)`` of every step of every order; 600 for five filters."""
    return [("".join(p), i + 1, 1 << filters.index(f)) for p in permutations(filters) for i, f in enumerate(p)]


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The metrics of every part, order and step, from ``mask_cells``.

    Cells are few (at most 32 a part) and each is unpivoted to the steps of all
    orders, a fixed array in the plan.
    """
    all_steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit")) for o, s, b in steps(filters)])
    rows = cells.withColumn("s", F.explode(all_steps)).select("part", "mask", "n", "n_good", "n_toxic", "s.*")
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    rows = rows.withColumn("failed", failed).withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    now, seen = F.col("failed") != 0, F.col("earlier") != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~now & ~seen).alias("kept"), total(now & ~seen).alias("removed"), total(now & seen).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(now & ~seen, "n_good").alias("good_lost"), total(now & ~seen, "n_toxic").alias("toxic_lost"),
    )
    whole = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return out.withColumn("shapley", whole).select("part", "filter_order", "step", *METRICS, "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS m FROM texts GROUP BY t),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < {MIN_WORDS})::INT AS a, (100 * len(list_distinct(w)) < {MIN_DISTINCT_PCT} * len(w))::INT AS b,
            (100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PCT} * length(words.t))::INT AS c, regexp_matches(words.t, '{SIGNS}')::INT AS d, coalesce((words.doc_id > m)::INT, 0) AS e
          FROM words JOIN least ON least.t = words.t LEFT JOIN marks ON marks.doc_id = words.doc_id),
cells AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM fails GROUP BY ALL),
orders AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order FROM (SELECT unnest(['A','B','C','D','E']) AS f) f1, (SELECT unnest(['A','B','C','D','E']) AS f) f2,
             (SELECT unnest(['A','B','C','D','E']) AS f) f3, (SELECT unnest(['A','B','C','D','E']) AS f) f4, (SELECT unnest(['A','B','C','D','E']) AS f) f5
           WHERE len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
steps AS (SELECT filter_order, i::INT AS step, (1 << (ascii(substr(filter_order, i::INT, 1)) - 65))::INT AS bit FROM orders, range(1, 6) r(i)),
masked AS (SELECT part, filter_order, step, bit, n, n_good, n_toxic, mask, (mask & bit) <> 0 AS failed,
             coalesce(bit_or(mask & bit) OVER (PARTITION BY part, filter_order, mask ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <> 0 AS earlier FROM cells, steps),
rows_ AS (SELECT part, filter_order, step, bit, sum(CASE WHEN NOT failed AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failed AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN failed AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN failed AND NOT earlier THEN n_good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failed AND NOT earlier THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM masked GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM rows_
"""
