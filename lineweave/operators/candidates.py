"""Candidate corrections of upper levels, and candidate links of orphans.  Advisory: nothing here changes a transition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import qn_vector, shifted, token_int
from .frames import empty

#: How far J of a candidate lies from that of the line, in order of preference.
OFFSETS = (-2, -1, 1, 2)
TOP = 5


def correction_candidates(suspects: DataFrame, energies: DataFrame, *, j_pos: int = 1) -> DataFrame:
    """(net, seq, pos, cand_level, dj_upper, dj_lower, mismatch, is_target): levels that could be a suspect line's upper one.

    The window of J is an equality join: each suspect asks for its shifted keys.  ``suspects`` are lines, with ``orig_upper`` if the truth
    is known (``is_target`` is null otherwise).  A suspect without candidates has no rows.
    """
    truth = F.col("orig_upper") if "orig_upper" in suspects.columns else F.lit(None).cast("string")
    offsets = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(d).alias("d")) for i, d in enumerate(OFFSETS)])
    asked = suspects.select("net", "seq", "upper", "lower", "freq", "unc", truth.alias("truth"), F.inline(offsets))
    asked = asked.withColumn("cand_level", shifted(F.col("upper"), j_pos, F.col("d"))).where(F.col("cand_level") != F.col("lower"))
    e = energies.select("net", "level", "energy")
    found = asked.join(e.select("net", F.col("level").alias("cand_level"), F.col("energy").alias("e_cand")), ["net", "cand_level"])
    found = found.join(e.select("net", F.col("level").alias("lower"), F.col("energy").alias("e_lower")), ["net", "lower"])
    jc, ju, jl = (token_int(F.col(c), j_pos) for c in ("cand_level", "upper", "lower"))
    off = F.abs(F.col("e_cand") - F.col("e_lower") - F.col("freq"))
    return found.select(
        "net", "seq", "pos", "cand_level", (F.abs(jc - ju) / 50.0).alias("dj_upper"), (F.abs(jc - jl) / 50.0).alias("dj_lower"),
        (F.log10(1.0 + off / F.col("unc")) / 4.0).alias("mismatch"), (F.col("cand_level") == F.col("truth")).alias("is_target"),
    )


def recoverable(candidates: DataFrame) -> DataFrame:
    """Candidates of the suspects whose truth is among them."""
    some = F.max(F.col("is_target").cast("int")).over(Window.partitionBy("net", "seq"))
    return candidates.withColumn("some", some).where("some = 1").drop("some")


def pair_features(orphan_levels: DataFrame, main_levels: DataFrame) -> DataFrame:
    """Every (orphan level, main level) of a net with the distance of each quantum number.

    All pairs are what is asked for: ``orphan_levels`` are a few levels of small detached parts, and they meet the main levels of their own
    net by an equality join.
    """
    o = orphan_levels.select("net", "orphan", F.col("level").alias("orphan_level"), qn_vector(F.col("level")).alias("q_o"))
    m = main_levels.select("net", F.col("level").alias("main_level"), qn_vector(F.col("level")).alias("q_m"))
    return o.join(m, "net").withColumn("dqn", F.zip_with("q_o", "q_m", lambda a, b: F.abs(a - b))).drop("q_o", "q_m")


def top_pairs(pairs: DataFrame, score: Column, *, k: int = TOP) -> DataFrame:
    """The ``k`` best pairs of each orphan, ties by orphan and main level, with ``score`` and ``rank``."""
    place = F.row_number().over(Window.partitionBy("net", "orphan").orderBy(F.desc("score"), "orphan_level", "main_level"))
    return pairs.withColumn("score", score).withColumn("rank", place).where(F.col("rank") <= k)


def _best_of_net(score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int):
    def run(key, o: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(o) or not len(m):
            return empty("net", "orphan", "orphan_level", "main_level", "score", "rank")
        m = m.sort_values("level")  # ties go by position, hence by name
        names, v = m["level"].to_numpy(), np.stack(m["v"].to_list())
        out = []
        for orphan, part in o.sort_values("level").groupby("orphan"):
            found = []
            for level, x in zip(part["level"], part["v"]):
                s = score(np.asarray(x), v)
                few = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                few = few[np.argsort(-s[few], kind="stable")[:k]]
                found += [(-s[i], level, names[i]) for i in few.tolist()]
            out += [(key[0], orphan, a, b, -x, r) for r, (x, a, b) in enumerate(sorted(found)[:k], 1)]
        return pd.DataFrame(out, columns=["net", "orphan", "orphan_level", "main_level", "score", "rank"])

    return run


def best_pairs(orphan_levels: DataFrame, main_levels: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], *, k: int = TOP) -> DataFrame:
    """(net, orphan, orphan_level, main_level, score, rank): the ``k`` best pairs of each orphan, ties by orphan and main level.

    ``orphan_levels(net, orphan, level, v)`` and ``main_levels(net, level, v)`` have a vector a level; ``score`` takes one vector and a
    matrix of main ones.  Pairs are scored one orphan level at a time and only the best are kept, so no pair becomes a row.
    """
    left, right = orphan_levels.select("net", "orphan", "level", "v"), main_levels.select("net", "level", "v")
    schema = "net string, orphan int, orphan_level string, main_level string, score double, rank int"
    return left.groupBy("net").cogroup(right.toDF(*right.columns).groupBy("net")).applyInPandas(_best_of_net(score, k), schema)


def correction_report(lines: DataFrame, outlier_logit: str, candidates: DataFrame, *, at: float = 0.0) -> DataFrame:
    """Best candidate of each line whose logit exceeds ``at``: reference, levels, proposal, probability and the window's softmax.

    ``candidates`` has ``logit``.  For review only: the report is terminal and no operator takes it for transitions.
    """
    flagged = lines.where(F.col(outlier_logit) > at).select("net", "seq", "ref", "upper", "lower", (1 / (1 + F.exp(-F.col(outlier_logit)))).alias("outlier_p"))
    top = F.max("logit").over(Window.partitionBy("net", "seq"))
    soft = candidates.withColumn("top", top).groupBy("net", "seq").agg(
        F.max_by("cand_level", F.struct("logit", -F.col("pos"))).alias("proposed_upper"), (1 / F.sum(F.exp(F.col("logit") - F.col("top")))).alias("confidence")
    )
    return flagged.join(soft, ["net", "seq"]).select("net", "seq", "ref", "upper", "lower", "proposed_upper", "outlier_p", "confidence")


def orphan_report(pairs: DataFrame, logit: str, *, k: int = TOP) -> DataFrame:
    """The best pairs of each orphan component with sigmoid scores, whose order has meaning and whose size has not.  For review only."""
    return top_pairs(pairs, 1 / (1 + F.exp(-F.col(logit))), k=k).select("net", "orphan", "orphan_level", "main_level", "score", "rank")
