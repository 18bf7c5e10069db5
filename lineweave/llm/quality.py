"""Quality rules: base counts and a hashed n-gram log-likelihood ratio of each whole text.

The method: character 4-grams of the text, its white space collapsed, are hashed into ``BUCKETS`` buckets.  Two multinomials
are counted, one over the texts labelled good (the trusted target), one over all texts (the raw corpus).  The corpus has add-one
smoothing; the target is smoothed towards the corpus with the weight of ``BUCKETS`` n-grams, so with little or nothing trusted all
scores go to 0.  A document's score is the sum over its n-grams of log p_target - log p_raw, divided by their number.  Weights are
rounded to whole millionths of a nat, so a score is an exact integer sum and the verdict never depends on summation order,
partitioning or machine.

A document is kept if it passes the base rules and its score reaches ``THRESHOLD_MICRO`` per n-gram.

Both counts cover all documents.  They are sums over ``BUCKETS`` counters, so what a task ships and what reaches the driver
has a fixed size.

Edge cases: null text has no words and fails the base rules; a text of fewer than four characters has no n-grams and score 0;
labels that are null, repeated or of unknown ids are ignored; without any trusted document every score is 0; repeated rows count each time; an empty table gives no rows; columns of other names are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map

BUCKETS = 65521
#: Multiplier of the polynomial hash of a gram's code points.
BASE = 521
GRAM = 4
#: Millionths of a nat per n-gram.  In corpora of some hundred documents, clean text of a language that is rare among the labelled
#: ones scores down to -0.3 per n-gram; text made of symbols, tables or capitals scores -0.5 and far less the larger the corpus.
THRESHOLD_MICRO = -400_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Buckets whose counters are shipped as one row.
BLOCK = 64
#: Size of the bitmap that is broadcast: 8 MiB whatever the labels.
FILTER_BITS = 1 << 26

_SLAB = 1 << 20


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Bucket of each 4-gram of code points of the text with collapsed white space, in slabs."""
    if not text:
        return
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]  # a space stays if something else stands before it
    c, space = c[keep], space[keep]
    c = np.where(space, 32, c).astype(np.int64)
    if len(c) and space[-1]:
        c = c[:-1]
    for at in range(0, len(c) - GRAM + 1, _SLAB):
        part = c[at : at + _SLAB + GRAM - 1]
        yield (((part[:-3] * BASE + part[1:-2]) * BASE + part[2:-1]) * BASE + part[3:]) % BUCKETS


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of the whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    a = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    k = len(index)
    if k < 2_000_000:
        windows = (a[:-2] * k + a[1:-1]) * k + a[2:]
    else:  # three such numbers no longer fit 63 bits
        pairs = np.unique(a[:-1] * k + a[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + a[2:]
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    covered = np.zeros(n, dtype=bool)
    for d in range(3):
        covered[d : n - 2 + d] |= again
    return int(covered.sum())


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how often each bucket occurs in ``texts(text)``.

    A task ships its counters in blocks of ``BLOCK``, as many rows whatever it has read; blocks are dealt by number and added up one
    by one, so memory is that of the counters.
    """

    def counted(batches):
        total = np.zeros(-(-BUCKETS // BLOCK) * BLOCK, dtype=np.int64)
        for b in batches:
            for t in b["text"]:
                for g in grams(t):
                    total += np.bincount(g, minlength=len(total))
        for k, part in enumerate(total.reshape(-1, BLOCK)):
            if part.any():
                yield k, part.tobytes()

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b["block"], b["counts"]):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, dtype=np.int64)
        for k, part in sums.items():
            for i in np.flatnonzero(part).tolist():
                yield k * BLOCK + i, int(part[i])

    blocks = arrow_map(texts.select("text"), counted, _schema("block int, counts binary"))
    return arrow_map(blocks.repartition("block"), added, _schema("bucket int, n long"), batch=4096)


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def log_ratios(texts: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Weight of each bucket in millionths of a nat.  At most ``BUCKETS`` rows come to the driver."""
    target, raw = bucket_counts(trusted).withColumnRenamed("n", "t"), bucket_counts(texts).withColumnRenamed("n", "r")
    counts = raw.join(target, "bucket", "full").select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r")).toPandas()
    t, r = np.zeros(BUCKETS), np.zeros(BUCKETS)
    t[counts.bucket], r[counts.bucket] = counts.t, counts.r
    q = (r + 1) / (r.sum() + BUCKETS)
    # half away from zero, as SQL rounds
    w = 1e6 * (np.log((t + BUCKETS * q) / (t.sum() + BUCKETS)) - np.log(q))
    return (np.sign(w) * np.floor(np.abs(w) + 0.5)).astype(np.int64)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold_micro: int = THRESHOLD_MICRO) -> DataFrame:
    """Base counts, verdicts and (llr_micro, n_grams) of each row of ``docs``."""

    def rows(batches):
        for b in batches:
            for i, t in zip(b["id"], b["text"]):
                n, chars, symbols, dup, rep = base_counts(t)
                total = count = 0
                for g in grams(t):
                    total += int(weights[g].sum())
                    count += len(g)
                failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n
                yield i, n, chars, symbols, dup, rep, failed, not failed and total >= threshold_micro * count, total, count

    schema = _schema("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr_micro long, n_grams long")
    schema["id"].dataType = docs.schema[id_col].dataType
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, schema)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts labelled good.  A bitmap of hashed ids, ``FILTER_BITS`` at most, drops other texts before the join shuffles them.

    Both joins are inner ones, as a semi-join would be pushed below the bitmap; the ids of ``good`` are distinct.  What is
    left after the bitmap is little more than the texts sought, so the join shuffles it at any size and its plan never changes.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bitmap = good.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    maybe = docs.select("doc_id", "text").withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "bucket")
    return maybe.where(F.getbit(byte, (place % 8).cast("int")) == 1).select("doc_id", "text").join(good.hint("merge"), "doc_id").select("text")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold_micro: int = THRESHOLD_MICRO) -> DataFrame:
    """One row per row of ``docs``: ids as ``id``, base counts, ``base_failed``, ``kept``, ``llr_micro``, ``n_grams``."""
    return score(docs, log_ratios(docs.select("text"), trusted_texts(docs, labels)), threshold_micro=threshold_micro)


def good_documents(docs: DataFrame, labels: DataFrame, threshold_micro: int = THRESHOLD_MICRO) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.  The verdict is taken where the text is; nothing is joined."""
    weights = log_ratios(docs.select("text"), trusted_texts(docs, labels))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                keep = []
                for t in b.column(b.schema.get_field_index("text")).to_pylist():
                    n, _, _, _, rep = base_counts(t)
                    ok = n >= MIN_WORDS and 100 * rep <= MAX_REPEAT_PERCENT * n
                    if ok:
                        total = count = 0
                        for g in grams(t):
                            total += int(weights[g].sum())
                            count += len(g)
                        ok = total >= threshold_micro * count
                    keep.append(ok)
                yield b.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
