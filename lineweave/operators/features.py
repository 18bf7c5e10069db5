"""Features of levels and lines of solved networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import QN_SLOTS, qn_vector
from ..session import written
from . import dissection, forest, kernels
from .network import bidirected, ends, keys
from .solve import _numbered, _parted, _weights, residuals

#: Quantum numbers are divided by this, logarithms by the other two.
QN_SCALE, LOG_SCALE, MISFIT_SCALE = 50.0, 10.0, 4.0
NODE_DIM, EDGE_DIM = QN_SLOTS + 6, 5


def _leverages_of_net(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, levels, u, l = _numbered(pdf)  # noqa: E741
    h = kernels.leverages(len(levels), u, l, _weights(pdf["unc"].to_numpy()))
    return pd.DataFrame({"net": pdf["net"].to_numpy(), "seq": pdf["seq"].to_numpy(), "leverage": h, "bridge": kernels.bridges(len(levels), u, l)})


def leverages(transitions: DataFrame, *, method: str = "by_net", most: int = dissection.MOST) -> DataFrame:
    """(net, seq, leverage, bridge) of each line: 1 where the solve takes a line over whole, near 0 where it is redundant.

    ``by_net`` takes each net in one task, or its parts; ``distributed`` spreads a net over tasks of ``most`` levels (see :mod:`.dissection`, :mod:`.forest`).
    """
    if method == "distributed":
        h = dissection.leverages_spread(transitions, most=most)
        cut = forest.bridges(transitions).withColumn("bridge", F.lit(True))
        pair = transitions.select("net", "seq", F.least("upper", "lower").alias("a"), F.greatest("upper", "lower").alias("b")).join(cut, ["net", "a", "b"], "left")
        return h.join(pair.select("net", "seq", F.coalesce("bridge", F.lit(False)).alias("bridge")), ["net", "seq"])
    if method != "by_net":
        raise ValueError(method)
    lines = _parted(transitions, "unc")
    return lines.groupBy(*keys(lines)).applyInPandas(_leverages_of_net, "net string, seq long, leverage double, bridge boolean")


def node_features(transitions: DataFrame, energies: DataFrame) -> DataFrame:
    """(net, comp, idx, level, x): quantum numbers, their count, degree, least, median and summed uncertainty, energy.

    The count is that of the net's first level.
    """
    unc = F.col("unc")
    stats = ends(transitions, "unc").groupBy("net", "level").agg(F.count("*").alias("degree"), F.min(unc).alias("least"), F.median(unc).alias("mid"), F.sum(1.0 / (unc * unc)).alias("load"))
    first = F.first_value("n").over(Window.partitionBy("net", "comp").orderBy("idx"))
    rows = energies.join(stats, ["net", "level"]).withColumn("n", F.size(F.split("level", " "))).withColumn("n", first)
    logs = [F.log10(F.col(c)) / LOG_SCALE for c in ("least", "mid", "load")]
    x = F.concat(F.transform(qn_vector(F.col("level")), lambda q: q / QN_SCALE), F.array(F.col("n") / float(QN_SLOTS), F.log1p(F.col("degree").cast("double")), *logs, F.log1p("energy") / LOG_SCALE))
    return rows.select("net", "comp", "idx", "level", x.alias("x"))


def line_features(transitions: DataFrame, energies: DataFrame, leverage: DataFrame) -> DataFrame:
    """(net, seq, upper, lower, attr): uncertainty, frequency, misfit, leverage and studentised misfit of each line.

    A frequency at or below -1 has no logarithm; its place is null.
    """
    r = residuals(transitions, energies).join(leverage.select("net", "seq", "leverage"), ["net", "seq"])
    h = F.col("leverage")
    stud = F.col("resid") / (F.col("unc") * F.sqrt(F.greatest(1.0 - h, F.lit(1e-12))))
    attr = F.array(F.log10("unc") / LOG_SCALE, F.log1p("freq") / LOG_SCALE, F.log10(1.0 + F.col("resid") / F.col("unc")) / MISFIT_SCALE, h, F.log10(1.0 + stud) / MISFIT_SCALE)
    return r.select("net", "seq", "upper", "lower", attr.alias("attr"))


def build_graph(transitions: DataFrame, energies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node features and both directions of each line with its features, ends as level numbers."""
    from .solve import solve_energies

    energies = energies if energies is not None else solve_energies(transitions)
    nodes = written(node_features(transitions, energies), "nodes")  # read three times
    lines = line_features(transitions, energies, leverages(transitions))
    number = nodes.select("net", "level", "idx", "comp")
    edges = bidirected(lines, "attr").join(number.select("net", F.col("level").alias("src"), F.col("idx").alias("src_idx"), "comp"), ["net", "src"])
    edges = edges.join(number.select("net", F.col("level").alias("dst"), F.col("idx").alias("dst_idx")), ["net", "dst"])
    return nodes, edges.select("net", "comp", "seq", "dir", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), "attr")


def as_arrays(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node matrix, (2, m) ends and edge matrix of one network, in order of number and of (seq, dir)."""
    nodes, edges = nodes.sort_values("idx"), edges.sort_values(["seq", "dir"])
    at = pd.Series(np.arange(len(nodes)), index=nodes["idx"].to_numpy())
    return np.stack(nodes["x"].to_list()), np.stack([at[edges["src"]].to_numpy(), at[edges["dst"]].to_numpy()]), np.stack(edges["attr"].to_list()).astype(float)
