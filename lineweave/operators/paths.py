"""Least path costs on networks that are larger than a task, by delta-stepping over tables.

Distances are dealt into buckets of a width that each net has of its own.  In a round every net works on its lowest bucket with work left:
levels of the bucket whose distance is new send it along their light edges, those no longer than the width, which may put others into the same
bucket; when none is left, the bucket's levels send along their heavy edges, once.  So short paths settle before long ones start, and
few edges are looked at more than a few times.  A round is a join of the frontier with the edges, a minimum by level, taken on the map side
first, and a join with the distances; all nets take part in the same rounds, and a net of any size is spread over all tasks.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

log = logging.getLogger(__name__)

#: Rounds after which something is wrong.
ROUNDS = 10_000


#: A bucket's width in mean costs of a net's edges: a round costs more here than an edge that is looked at twice, so buckets are wide.
WIDTH = 4.0


def widths(edges: DataFrame, factor: float = WIDTH) -> DataFrame:
    """(net, width, heavy): the mean cost of a net's edges times ``factor``, 1 if all cost nothing, and whether longer edges exist."""
    mean = F.avg("cost") * factor
    return edges.groupBy("net").agg(F.when(mean > 0, mean).otherwise(1.0).alias("width"), (F.max("cost") > F.when(mean > 0, mean).otherwise(1.0)).alias("heavy"))


def least_costs(edges: DataFrame, roots: DataFrame, width: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((net, level, dist), rounds): least cost from any of ``roots(net, level)`` along ``edges(net, src, dst, cost)``.

    Costs are at least 0; of several edges between two levels the cheapest counts.  Levels that no root reaches are absent.
    """
    least = edges.groupBy("net", "src", "dst").agg(F.min("cost").alias("cost"))
    width = width if width is not None else widths(edges)
    edges = written(least.join(width.drop("heavy"), "net").withColumn("light", F.col("cost") <= F.col("width")), "edges")
    start = roots.select("net", "level").distinct().join(width, "net")
    # ``fresh``: the distance hasn't gone along light edges yet; ``owed``: it hasn't gone along heavy ones
    state = written(start.select("net", "level", "width", "heavy", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh"), F.col("heavy").alias("owed")), "distances")
    bucket = F.floor(F.col("dist") / F.col("width"))
    for number in range(ROUNDS):
        # the lowest bucket with work comes first, in it light edges: false sorts before true
        turn = F.min(F.struct(bucket.alias("bucket"), (~F.col("fresh")).alias("heavy"))).alias("turn")
        now = state.where("fresh OR owed").groupBy("net").agg(turn).select("net", "turn.bucket", F.col("turn.heavy").alias("late"))
        active = state.where("fresh OR owed").withColumn("bucket", bucket).join(now, ["net", "bucket"]).where(F.col("late") | F.col("fresh"))
        sent = active.select("net", F.col("level").alias("src"), "dist", "late", "heavy").join(edges, ["net", "src"]).where(F.col("light") != F.col("late"))
        offers = sent.groupBy("net", F.col("dst").alias("level")).agg(F.min(F.col("dist") + F.col("cost")).alias("offer"), F.first("width").alias("_width"), F.first("heavy").alias("_heavy"))
        worked = active.select("net", "level", F.col("late").alias("did_heavy"))
        both = state.join(worked, ["net", "level"], "left").join(offers, ["net", "level"], "full")
        better = F.col("dist").isNull() | (F.col("offer") < F.col("dist"))
        better = F.coalesce(better & F.col("offer").isNotNull(), F.lit(False))
        did = F.col("did_heavy")
        state = written(
            both.select(
                "net", "level", F.coalesce("width", "_width").alias("width"), F.coalesce("heavy", "_heavy").alias("heavy"), F.when(better, F.col("offer")).otherwise(F.col("dist")).alias("dist"),
                F.when(better, True).when(did.isNotNull(), False).otherwise(F.col("fresh")).alias("fresh"), F.when(better, F.coalesce("heavy", "_heavy")).when(did, False).otherwise(F.col("owed")).alias("owed"),
            ),
            "distances",
        )
        if state.where("fresh OR owed").isEmpty():
            log.info("least costs: %d rounds", number + 1)
            return state.select("net", "level", "dist"), number + 1
    raise RuntimeError(f"least costs did not settle in {ROUNDS} rounds")


def by_uncertainty(transitions: DataFrame) -> DataFrame:
    """(net, src, dst, cost): both directions of each line at the square of its uncertainty."""
    both = F.array(F.struct(F.col("upper").alias("src"), F.col("lower").alias("dst")), F.struct(F.col("lower").alias("src"), F.col("upper").alias("dst")))
    return transitions.select("net", F.inline(both), F.pow("unc", F.lit(2)).alias("cost"))


def by_entry(transitions: DataFrame, costs: DataFrame) -> DataFrame:
    """(net, src, dst, cost): entering a level costs what ``costs(net, level, cost)`` says; a level without a cost isn't entered nor left."""
    edges = by_uncertainty(transitions).drop("cost").distinct()
    into = costs.where(F.col("cost").isNotNull()).select("net", F.col("level").alias("dst"), "cost")
    return edges.join(into, ["net", "dst"]).join(into.select("net", F.col("dst").alias("src")), ["net", "src"], "left_semi").select("net", "src", "dst", "cost")
