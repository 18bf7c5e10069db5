"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Documents are aggregated by encoded length (map-side first).  With counts and token sums of all documents of at least a length
at hand, any question about a context limit L is one lookup: documents longer than L, tokens left by truncation to L
(sum of the shorter ones + L times the number of the longer ones), and quantiles of the length.

A limit that is no document's length joins the lengths with no documents; a quantile is answered by the row whose counts enclose it.
Neither needs a join by range.

Suffix sums go in two levels, so no task sees the whole histogram: over ranges of ``SPAN`` lengths (one row per range), then
within each range.

Edge cases: null or empty text counts the end id alone; repeated rows count each time; an empty table gives an empty histogram,
and answers over it are zero or null; columns of other names are passed by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import written

VOCABULARY = "byte_bpe_50k.json"
#: Lengths that one task of the second level holds.
SPAN = 256
#: Context limits and quantiles that the report answers.
LIMITS = tuple(2**i for i in range(7, 18))
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length): encoded length with the end id of each row of ``docs(text)``."""

    def run(batches):
        import pyarrow as pa

        enc = tokens.of_vocabulary(vocabulary)
        for b in batches:
            for x in range(0, b.num_rows, 1024):
                n = [len(i) + 1 for i in enc.encode_column(b.column(0).slice(x, 1024))]
                yield pa.RecordBatch.from_arrays([pa.array(n, type=pa.int64())], names=["length"])

    return docs.select("text").mapInArrow(run, T.StructType([T.StructField("length", T.LongType())]))


def histogram(lengths: DataFrame, limits: Sequence[int] = ()) -> DataFrame:
    """(length, n_docs, docs_at_least, tokens_at_least, docs_below, tokens_below, truncated_total), one row per length and limit.

    ``truncated_total`` is what is left of all documents cut to ``length`` tokens.  Lengths that only ``limits`` name have no documents.
    """
    return _suffix_sums(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), limits)


def _suffix_sums(counts: DataFrame, limits: Sequence[int]) -> DataFrame:
    if limits:
        asked = counts.sparkSession.createDataFrame([(int(x), 0) for x in limits], "length long, n_docs long")
        counts = counts.unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    # written, as it is read twice and the texts should be encoded once
    h = written(counts, "lengths").withColumn("span", F.floor(F.col("length") / SPAN))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    tails = spans.select(
        "span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(Window.partitionBy()).alias("d_all"), F.sum("t").over(Window.partitionBy()).alias("t_all"),
    )
    own = Window.partitionBy("span").orderBy(F.desc("length"))
    at_least = h.join(tails, "span").select(
        "length", "n_docs", (F.sum("n_docs").over(own) + F.col("d_after")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("length")).over(own) + F.col("t_after")).alias("tokens_at_least"), "d_all", "t_all",
    )
    return at_least.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least", (F.col("d_all") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("t_all") - F.col("tokens_at_least")).alias("tokens_below"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
    )


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, docs_over, truncated_total) for any context limits: they join the lengths, and suffix sums are taken over both."""
    rows = _suffix_sums(hist.select("length", "n_docs"), limits).where(F.col("length").isin([int(x) for x in limits]))
    return rows.select(F.col("length").alias("limit"), (F.col("docs_at_least") - F.col("n_docs")).alias("docs_over"), "truncated_total")


def answered(of: Sequence[float]) -> Column:
    """Those of the quantiles whose answer a row of the histogram is: the smallest length that at least this share of the documents does not exceed."""
    rank = lambda q: q * (F.col("docs_below") + F.col("docs_at_least"))
    mine = F.filter(F.array(*[F.lit(float(q)) for q in of]), lambda q: (F.col("docs_below") + F.col("n_docs") >= rank(q)) & ((F.col("docs_below") < rank(q)) | (F.col("docs_below") == 0)))
    return F.when(F.col("n_docs") > 0, mine).otherwise(F.array().cast("array<double>"))


def quantiles(hist: DataFrame, of: Sequence[float]) -> DataFrame:
    """(quantile, length): a row per quantile asked for; the length is null without documents."""
    asked = hist.sparkSession.createDataFrame([(float(x),) for x in of], "quantile double")
    found = hist.select(F.explode(answered(of)).alias("quantile"), "length")
    return asked.join(F.broadcast(found), "quantile", "left")


def report(lengths: DataFrame, limits: Sequence[int] = LIMITS, of: Sequence[float] = QUANTILES) -> DataFrame:
    """The histogram with the context limits among its lengths: ``is_limit`` marks them, ``quantiles`` lists those that a length answers."""
    hist = histogram(lengths, limits)
    return hist.withColumn("is_limit", F.col("length").isin(list(limits))).withColumn("quantiles", F.array_join(answered(of), ","))
