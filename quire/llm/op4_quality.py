"""Quality rules: base word rules plus compression bands.

The method's verdict compares zstandard ratios (raw bytes / compressed bytes)
with bands.  A text is judged as a whole by the band for its length, and chunk
by chunk (fixed ``CHUNK`` bytes) by the band for chunks: too high a ratio is
repetitive text, too low a one is incompressible text.  The last, shorter chunk
is judged by the band for its own length; bad chunks count by their bytes, since
a last chunk of a few bytes never compresses.

Defined results: a null or empty text has no words and fails the base rule;
texts of any length are read whole; rows are judged alone, so repeated rows and
an empty table need no rule; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LEVEL = 3
CHUNK = 4096
#: (up to so many bytes, lowest ratio, highest ratio).  Short texts compress less, so both limits rise with length.
#: The highest is 0.02 above the highest ratio of prose labelled good with an even doc_id (sf0.1), over 12,800
#: bytes just above that of such prose joined to texts of that length.
BANDS = [
    (400, 1.05, 1.74),
    (570, 1.15, 1.86),
    (800, 1.15, 1.87),
    (1130, 1.30, 2.01),
    (1600, 1.30, 2.06),
    (2260, 1.45, 2.12),
    (3200, 1.45, 2.17),
    (4096, 1.50, 2.24),
    (6400, 1.50, 2.31),
    (9050, 1.55, 2.36),
    (12800, 1.55, 2.38),
    (25600, 1.60, 2.50),
    (51200, 1.60, 2.57),
    (102400, 1.60, 2.64),
    (204800, 1.60, 2.69),
    (1 << 62, 1.60, 2.75),
]
#: A text fails when more than this share of its bytes lie in chunks that leave their bands.
BAD_CHUNK_SHARE = 0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_SPACE = b" \t\n\x0b\x0c\r"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks long"
)
COLUMNS = [x.split() for x in SCHEMA.split(", ")]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    first: dict = {}
    marked = bytearray(n + 2)
    hit = False
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(w, i)
        if j != i:
            marked[i : i + 3] = marked[j : j + 3] = b"\x01\x01\x01"
            hit = True
    return sum(marked) if hit else 0


def in_band(size: int, ratio: float) -> bool:
    low, high = next((lo, hi) for most, lo, hi in BANDS if size <= most)
    return low <= ratio <= high


def compression_verdict(raw: bytes, compress) -> tuple[bool, float, int]:
    """(kept, ratio of the whole, chunks outside their bands)."""
    if not raw:
        return False, 0.0, 0
    ratio = len(raw) / len(compress(raw))
    bad = bad_bytes = 0
    if len(raw) > CHUNK:
        for i in range(0, len(raw), CHUNK):
            part = raw[i : i + CHUNK]
            if not in_band(len(part), len(part) / len(compress(part))):
                bad += 1
                bad_bytes += len(part)
    return in_band(len(raw), ratio) and bad_bytes <= BAD_CHUNK_SHARE * len(raw), ratio, bad


def judge(text: str | None, compress) -> tuple:
    """One text's row without its id."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text or "") - sum(map(raw.count, (bytes([b]) for b in _SPACE)))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    fine, ratio, bad = compression_verdict(raw, compress)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, not failed and fine, ratio, bad


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    for batch in batches:
        rows = [judge(t.as_py(), compress) for t in batch.column(1)]
        columns = list(zip(*rows)) if rows else [()] * (len(COLUMNS) - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(c, types[k]) for c, (_, k) in zip(columns, COLUMNS[1:]))],
            names=[n for n, _ in COLUMNS],
        )


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row of counts and verdicts for each row of ``docs(doc_id, text)``; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_judge_batches, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text passes; judged in place, without a join."""
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def kept(texts):
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        return texts.map(lambda t: judge(t, compress)[6])

    return docs.where(kept("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return judge_quality(table(spark, sf_dir, "documents"))
