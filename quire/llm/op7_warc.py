"""WARC archives: writing, and reading by boundary-chain verification.

Writing: a record is a line of Spark's text writer whose separator is the
record's closing CRLF CRLF, so archives go to any file system Spark writes to.
Of equal payloads of at least ``LEAST`` bytes, the one with the smallest
page_id is a response; the others are revisits, which hold no payload but its
digest and length.

Reading: archives are split at the magic ``WARC/1.`` by the text reader, which
splits files between tasks.  Each piece is a candidate record; its header tells
the offset of its successor.  Candidates inside payloads are rejected by
reachability: runs of candidates that follow each other directly are
contracted, and pointer jumping from offset 0 of each file doubles the reach
each round.  A record's payload is taken from its own piece where that is
whole; else the pieces that its length covers are put together again.

Defined results: null html is an empty payload; small or unique payloads are
responses; repeated rows of a response are responses too; rows with a null page_id
are responses, and no other row refers to them;
an empty table gives an empty archive and no rows; other columns are ignored.
Bytes that no chain from a file's start reaches are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stage, stage_path, table

LEAST = 100
MAGIC = "WARC/1."
END = "\r\n\r\n"
#: Repeated payloads up to this many digests (about 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_DIGESTS = 50_000


def write_archive(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages(page_id, url, html)``; one archive file a task."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"),
        F.octet_length(payload).alias("n"), F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    # Digests first, without payloads; only those that occur again take part in the join.
    again = (
        rows.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
        .where("rows > 1").select("digest", "first")
    )
    again = stage(again, "warc-again")
    if again.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        again = F.broadcast(again)
    rows = rows.join(again, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    target = F.regexp_replace("url", r"[\r\n]", "%0A")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    common = F.concat(
        F.lit("1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    rows.select(F.concat(F.lit(MAGIC), common, body).alias("value")).write.option("lineSep", END).text(path)


def _between(head, name: str):
    return F.regexp_extract(head, rf"(?i)\r\n{name}: *([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece that follows the magic: ``file, block, k`` (its place), ``bytes``, the header's fields."""
    piece = F.col("value").cast("binary")
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("k"),
        F.col("value"),
        piece.alias("piece"),
    )
    # Header names and numbers are ASCII; the header ends at the first empty line.
    head_n = F.instr("value", END)
    head = F.when((head_n > 0) & F.col("value").rlike(r"^[01]\r\n"), F.concat(F.lit("\r\n"), F.expr("substr(value, 1, instr(value, '\\r\\n\\r\\n') + 1)")))
    return raw.withColumn("head", head).withColumn("head_bytes", F.octet_length("head")).withColumn(
        "length", F.expr("try_cast(nullif(regexp_extract(head, '(?i)\\r\\ncontent-length: *([0-9]+)', 1), '') as bigint)")
    )


def _fields() -> list:
    return [
        _between(F.col("head"), "WARC-Type").alias("record_type"),
        F.regexp_extract(_between(F.col("head"), "WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).alias("page"),
        F.regexp_extract(_between(F.col("head"), "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).alias("refers"),
        _between(F.col("head"), "X-Payload-Length").alias("full_bytes"),
        _between(F.col("head"), "WARC-Payload-Digest").alias("told_digest"),
    ]


def reachable(nodes: DataFrame) -> DataFrame:
    """Runs that a chain from the file's start reaches: pointer jumping over ``nodes(file, run, next, start)``.

    A run's next one lies behind it, so links get longer each round until none
    is left, however long the chain.
    """
    link, reach = nodes.select("file", "run", "next"), nodes.where("start").select("file", "run")
    known, old = reach.count(), []
    while link.where("next is not null").limit(1).count():
        ahead = reach.join(link, ["file", "run"]).where("next is not null").select("file", F.col("next").alias("run"))
        reach = stage(reach.union(ahead).distinct(), "warc-reach")
        onward = link.select("file", F.col("run").alias("next"), F.col("next").alias("onward"))
        link = stage(link.join(onward, ["file", "next"], "left").select("file", "run", F.col("onward").alias("next")), "warc-jump")
        discard(*old)
        old, now = [reach, link], reach.count()
        if now == known:
            break
        known = now
    return reach


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Reachable records: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    magic = len(MAGIC)
    found = candidates(spark, path)
    whole = F.octet_length("piece") == F.col("head_bytes") + F.col("length") + 4
    body = F.expr("substring(piece, head_bytes + 1, cast(length as int))")
    narrow = stage(
        found.select(
            "file", "block", "k", F.octet_length("piece").alias("n"),
            (F.col("head_bytes") + magic).alias("head_n"), "length", *_fields(),
            F.when(whole, F.sha2(body, 256)).alias("digest"),
        ),
        "warc-candidates",
    )
    # Offsets: blocks of a file are chained by their totals, pieces within a block by their sizes.
    sized = F.col("n") + magic
    blocks = narrow.groupBy("file", "block").agg(F.sum(sized).alias("total"))
    chain = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(chain), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("within", F.coalesce(F.sum(sized).over(inside), F.lit(0))).join(blocks, ["file", "block"])
    # The text before the first magic is a piece too; it has no magic of its own, hence the shift.
    placed = placed.withColumn("off", F.col("base") + F.col("within") - magic)
    placed = placed.withColumn("succ", F.when(F.col("length").isNotNull(), F.col("off") + F.col("head_n") + F.col("length") + 4))
    by_file = Window.partitionBy("file").orderBy("off")
    placed = placed.withColumn("follows", F.lead("off").over(by_file)).withColumn("direct", F.col("succ").eqNullSafe(F.col("follows")))
    placed = stage(placed.drop("base", "within"), "warc-placed")

    # Targets of jumps over candidates start runs of their own, as do candidates that nothing leads to directly.
    jumps = placed.where("succ is not null and not direct").select("file", F.col("succ").alias("off"), F.lit(True).alias("target")).distinct()
    runs = placed.join(jumps, ["file", "off"], "left").withColumn(
        "head_of_run", F.col("target").isNotNull() | ~F.coalesce(F.lag("direct").over(by_file), F.lit(False))
    )
    runs = runs.withColumn("run", F.max(F.when(F.col("head_of_run"), F.col("off"))).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    runs = stage(runs.drop("target", "head_of_run"), "warc-runs")
    ends = runs.groupBy("file", "run").agg(F.max_by("succ", "off").alias("next"))
    starts = ends.select("file", F.col("run").alias("next"), F.lit(True).alias("there"))
    nodes = ends.join(starts, ["file", "next"], "left").select(
        "file", "run", F.when(F.col("there"), F.col("next")).alias("next"), (F.col("run") == 0).alias("start")
    )
    nodes = stage(nodes, "warc-nodes")
    records = runs.join(reachable(nodes), ["file", "run"]).where("length is not null")

    whole_records = records.where("digest is not null")
    torn = records.where("digest is null")
    if torn.limit(1).count():
        whole_records = whole_records.unionByName(_mend(found, placed, torn))
    kept = F.col("record_type") == "revisit"
    return whole_records.select(
        F.expr("try_cast(page as bigint)").alias("page_id"),
        F.when(kept, F.expr("try_cast(full_bytes as bigint)")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(kept, F.regexp_replace("told_digest", "^sha256:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(nullif(refers, '') as bigint)").alias("refers_to"),
    )


def _mend(found: DataFrame, placed: DataFrame, torn: DataFrame) -> DataFrame:
    """Digests of records whose payload holds the magic: their pieces are read again and joined in order."""
    files = torn.select("file").distinct()
    # A second scan sees the same blocks; within a block, pieces keep their order.
    again = found.join(files, "file", "left_semi").select("file", "block", "k", "piece")
    inside = Window.partitionBy("file", "block").orderBy("k")
    again = again.withColumn("i", F.row_number().over(inside)).drop("k")
    spots = placed.select("file", "block", "k", "off", "n").withColumn("i", F.row_number().over(inside)).drop("k")
    spots = spots.join(files, "file", "left_semi")
    spans = torn.select("file", F.col("off").alias("at"), F.col("succ").alias("until"))
    # Each piece belongs to the last reachable record that starts at or before it.
    marks = spans.select("file", F.col("at").alias("off"), F.struct("at", "until").alias("span"))
    by_file = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owned = spots.join(marks, ["file", "off"], "left").withColumn("span", F.last("span", ignorenulls=True).over(by_file))
    owned = owned.where(F.col("off") < F.col("span.until"))
    parts = owned.join(again, ["file", "block", "i"]).groupBy("file", F.col("span.at").alias("off")).agg(
        F.array_sort(F.collect_list(F.struct("off", "piece"))).alias("parts")
    )
    joined = F.aggregate(
        F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))),
        F.col("parts")[0]["piece"],
        lambda a, x: F.concat(a, F.lit(MAGIC.encode()), x["piece"]),
    )
    parts = parts.select("file", "off", joined.alias("all"))
    back = torn.drop("digest").join(parts, ["file", "off"])
    body = F.expr(f"substring(all, head_n - {len(MAGIC)} + 1, cast(length as int))")
    fine = F.octet_length("all") >= F.col("head_n") - len(MAGIC) + F.col("length")
    return back.where(fine).withColumn("digest", F.sha2(body, 256)).drop("all").select(*torn.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)
