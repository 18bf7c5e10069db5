"""Ranking, detection and calibration metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bounds of the bins of shift size, in uncertainties; half open.
MAG_BINS = (5.0, 15.0, 50.0, 150.0, 500.0)


def rank_of_truth(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, rank, n): 1 + how many of the query's rows score above the true one; equal scores don't count.

    ``scored`` has ``score`` and ``is_target``; a query without a true row is left out.
    """
    best = F.max(F.when(F.col("is_target"), F.col("score"))).alias("true_score")
    truth = scored.groupBy(*keys).agg(best, F.count("*").alias("n")).where("true_score is not null")
    above = scored.join(truth, list(keys)).groupBy(*keys).agg(F.count_if(F.col("score") > F.col("true_score")).alias("above"), F.first("n").alias("n"))
    return above.select(*keys, (F.col("above") + 1).alias("rank"), "n")


def link_metrics(ranks: DataFrame) -> DataFrame:
    return ranks.agg(
        F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= 1).cast("double")).alias("hits1"), F.avg((F.col("rank") <= 5).cast("double")).alias("hits5"),
        F.median("rank").alias("median_rank"), F.avg("n").alias("n_pairs"),
    )


def fix_metrics(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg((F.col("rank") == 1).cast("double")).alias("acc"), F.avg(1 / F.col("rank")).alias("mrr"), F.count("*").alias("n"), F.avg("n").alias("n_cand"))


#: Ranges of scores whose counts are summed before those of single scores.
SCORE_RANGES = 64


def _score_range(rows: DataFrame) -> Column:
    """Number of the range, about as many rows in each, that a score is in; a missing score is below all."""
    cuts = rows.select("score").where(F.col("score").isNotNull() & ~F.isnan("score")).approxQuantile("score", [k / SCORE_RANGES for k in range(1, SCORE_RANGES)], 1 / (4 * SCORE_RANGES))
    bounds = sorted(set(cuts))
    if not bounds:
        return F.lit(0)

    def at(lo: int, hi: int) -> Column:  # how many bounds are at or below the score, by halving
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("score") >= F.lit(float(bounds[mid])), at(mid + 1, hi)).otherwise(at(lo, mid))

    return F.coalesce(at(0, len(bounds)), F.lit(0))


def average_precision(rows: DataFrame, label: Column, *keys: str, tie: tuple[str, ...] = ("net", "seq")) -> DataFrame:
    """(keys, ap): mean over the positives of the share of positives down to them, by score; null without positives.

    Ties go by ``tie``.  Running sums go in three levels: over ``SCORE_RANGES`` ranges of scores, over the distinct scores of a range, and
    within a score, so no task sees all rows or all scores.
    """
    part = list(keys)
    narrow = written(rows.select(*dict.fromkeys([*part, *tie, "score"]), label.cast("int").alias("_y")), "scores")  # read three times
    score_rows = narrow.withColumn("_range", _score_range(narrow))
    per = score_rows.groupBy(*part, "_range", "score").agg(F.sum("_y").alias("_p"), F.count("*").alias("_c"))
    ranges = per.groupBy(*part, "_range").agg(F.sum("_p").alias("_p"), F.sum("_c").alias("_c"))
    above = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    down = Window.partitionBy(*part).orderBy(F.desc("_range"))
    tops = ranges.select(*part, "_range", above(down, "_p").alias("_pr"), above(down, "_c").alias("_cr"))
    inner = Window.partitionBy(*part, "_range").orderBy(F.desc("score"))
    before = per.select(*part, "_range", "score", above(inner, "_p").alias("_pb"), above(inner, "_c").alias("_cb")).join(tops, [*part, "_range"])
    own = Window.partitionBy(*part, "_range", "score").orderBy(*tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = score_rows.withColumn("_pi", F.sum("_y").over(own)).withColumn("_ci", F.count("*").over(own)).join(before, [*part, "_range", "score"])
    at = (F.col("_pr") + F.col("_pb") + F.col("_pi")) / (F.col("_cr") + F.col("_cb") + F.col("_ci"))
    total = [F.try_divide(F.sum(F.when(F.col("_y") == 1, at)), F.sum("_y")).alias("ap")]
    return placed.groupBy(*part).agg(*total) if part else placed.agg(*total)


def mean_over(per_net: DataFrame, *metrics: str) -> DataFrame:
    """(metrics): mean over networks of metrics that each network has; nulls, of networks without one, are left out."""
    return per_net.agg(*[F.avg(m).alias(m) for m in metrics])


def spread_of_errors(errors: DataFrame) -> DataFrame:
    """(net, level, n, spread): population deviation of each level's refit errors, lost ones left out."""
    finite = F.when(~F.isnan("err"), F.col("err"))
    return errors.groupBy("net", "level").agg(F.count(finite).alias("n"), F.stddev_pop(finite).alias("spread"))


def preview(report: DataFrame, *order: Column | str, k: int = 10) -> DataFrame:
    """The first ``k`` rows of a report, each with ``more``, how many the report has beyond them."""
    total = report.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return report.orderBy(*order).limit(k).join(F.broadcast(total))


def detection(rows: DataFrame, *, at: float = 0.0) -> DataFrame:
    """(precision, recall, base) of scores above ``at`` against ``kind`` > 0; precision is null if nothing is flagged."""
    bad, flagged = (F.col("kind") > 0), (F.col("score") > at)
    return rows.agg(
        F.avg(F.when(flagged, bad.cast("double"))).alias("precision"), F.avg(F.when(bad, flagged.cast("double"))).alias("recall"), F.avg(bad.cast("double")).alias("base")
    )


def precision_at_k(rows: DataFrame, *keys: str) -> DataFrame:
    """(p_at_k): mean over graphs of the share of bad lines among a graph's k best scores, k the number of its bad lines."""
    by = Window.partitionBy(*keys)
    top = rows.withColumn("_k", F.count_if(F.col("kind") > 0).over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc("score"), "seq"))).where("_r <= _k")
    return top.groupBy(*keys).agg(F.avg((F.col("kind") > 0).cast("double")).alias("p")).agg(F.avg("p").alias("p_at_k"))


def by_kind(rows: DataFrame, *, at: float = 0.0) -> DataFrame:
    """(kind, ap, recall): each kind of defect against clean lines."""
    pair = rows.withColumn("of", F.explode(F.when(F.col("kind") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("kind").cast("int")))))
    ap = average_precision(pair, F.col("kind") > 0, "of")
    recall = rows.where("kind > 0").groupBy(F.col("kind").cast("int").alias("of")).agg(F.avg((F.col("score") > at).cast("double")).alias("recall"))
    return ap.join(recall, "of", "left").select(F.col("of").alias("kind"), "ap", "recall")


def by_magnitude(rows: DataFrame, *, at: float = 0.0) -> DataFrame:
    """(lo, hi, n, recall) of frequency shifts in half-open bins; empty bins stay, with a null recall."""
    spark = rows.sparkSession
    bins = spark.createDataFrame(list(zip(MAG_BINS, MAG_BINS[1:])), "lo double, hi double")
    edge = F.array(*[F.lit(b) for b in MAG_BINS])
    lo = F.array_max(F.filter(edge, lambda b: b <= F.col("mag")))
    found = rows.where((F.col("kind") == 1) & (F.col("mag") >= MAG_BINS[0]) & (F.col("mag") < MAG_BINS[-1])).groupBy(lo.alias("lo")).agg(F.count("*").alias("n"), F.avg((F.col("score") > at).cast("double")).alias("recall"))
    return bins.join(found, "lo", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "recall")


def gaussian_nll(errors: DataFrame, sigma: DataFrame) -> DataFrame:
    """(nll, coverage): mean of log sigma + err^2 / (2 sigma^2), and the share of errors within sigma, over finite errors."""
    joined = errors.where(F.col("err").isNotNull() & ~F.isnan("err")).join(sigma.select("net", "level", "sigma"), ["net", "level"])
    nll = F.log("sigma") + F.col("err") * F.col("err") / (2 * F.col("sigma") * F.col("sigma"))
    return joined.agg(F.avg(nll).alias("nll"), F.avg((F.abs("err") <= F.col("sigma")).cast("double")).alias("coverage"))


def within_sigma(computed: DataFrame, published: DataFrame) -> DataFrame:
    """(net, share): published energies within the computed uncertainty."""
    j = computed.join(published.select("net", "level", F.col("energy").alias("given")), ["net", "level"])
    return j.groupBy("net").agg(F.avg((F.abs(F.col("energy") - F.col("given")) <= F.col("unc")).cast("double")).alias("share"))


def positive_weight(rows: DataFrame) -> DataFrame:
    return rows.agg(F.try_divide(F.count_if(F.col("kind") == 0), F.count_if(F.col("kind") > 0)).alias("pos_weight"))


def weighted_log_loss(rows: DataFrame, pos_weight: float) -> DataFrame:
    """(loss): mean of -(w y log p + (1-y) log(1-p)) with p the sigmoid of ``logit``, computed without overflow."""
    x, y = F.col("logit"), F.col("label").cast("double")
    soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return rows.agg(F.avg(F.lit(pos_weight) * y * soft(-x) + (1 - y) * soft(x)).alias("loss"))


def window_cross_entropy(candidates: DataFrame, *keys: str) -> DataFrame:
    """(loss): mean over suspects of the log-sum of the window minus the true logit."""
    by = Window.partitionBy(*keys)
    top = candidates.withColumn("_m", F.max("logit").over(by))
    per = top.groupBy(*keys).agg((F.log(F.sum(F.exp(F.col("logit") - F.col("_m")))) + F.first("_m") - F.max(F.when(F.col("is_target"), F.col("logit")))).alias("l"))
    return per.agg(F.avg("l").alias("loss"))
