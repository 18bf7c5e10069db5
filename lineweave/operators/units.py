"""Units of lines whose list does not tell them, inferred from published levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HZ, LIGHT_CM_S, UNC_FLOOR, tag

#: Candidates in order of preference.
UNITS = ("cm-1", *HZ)


def checkable(transitions: DataFrame, levels: DataFrame, *, how: str = "inner") -> DataFrame:
    """Lines whose two levels are known, with ``tag`` and ``diff``, the difference of the levels; if ``how`` is left, other lines too, their ``found_upper`` or ``found_lower`` being null."""
    lv = levels.select("net", "level", "energy")
    up = transitions.join(lv.select("net", F.col("level").alias("upper"), F.col("energy").alias("e_upper"), F.lit(True).alias("found_upper")), ["net", "upper"], how)
    both = up.join(lv.select("net", F.col("level").alias("lower"), F.col("energy").alias("e_lower"), F.lit(True).alias("found_lower")), ["net", "lower"], how)
    return both.withColumn("tag", tag(F.col("ref"))).withColumn("diff", F.col("e_upper") - F.col("e_lower"))


def _matches(factor: float):
    scaled = F.abs(F.col("freq") * factor - F.col("diff"))
    return scaled <= 3 * F.greatest(F.col("unc") * factor, F.lit(UNC_FLOOR))


def unit_report(transitions: DataFrame, levels: DataFrame) -> DataFrame:
    """(net, tag, lines, n_<unit>...): how many checkable lines agree with the levels in each unit; all tags are listed.

    Lines of frequency below zero name their tag and are not checked.  All tags and units are counted in one pass over the lines.
    """
    known = checkable(transitions, levels, how="left").withColumn("known", ~(F.col("freq") < 0) & F.col("found_upper") & F.col("found_lower"))
    counts = [F.count_if(F.col("known") & _matches(HZ.get(u, LIGHT_CM_S) / LIGHT_CM_S)).alias(f"n_{u}") for u in UNITS]
    return known.groupBy("net", "tag").agg(F.count_if("known").alias("lines"), *counts)


def infer_units(report: DataFrame) -> DataFrame:
    """(net, tag, unit): the unit that most lines agree with; ties and tags without lines go to the earlier candidate."""
    best = F.array_max(F.array(*[F.struct(F.col(f"`n_{u}`").alias("n"), F.lit(-i).alias("order"), F.lit(u).alias("unit")) for i, u in enumerate(UNITS)]))
    return report.select("net", "tag", best["unit"].alias("unit"))


def closure(transitions: DataFrame, levels: DataFrame) -> DataFrame:
    """(net, lines, checked, misses): lines that known levels miss by more than three uncertainties."""
    miss = F.abs(F.col("freq") - F.col("diff")) > 3 * F.greatest("unc", F.lit(UNC_FLOOR))
    found = checkable(transitions, levels).groupBy("net").agg(F.count("*").alias("checked"), F.count_if(miss).alias("misses"))
    return transitions.groupBy("net").agg(F.count("*").alias("lines")).join(found, "net", "left").na.fill(0)
