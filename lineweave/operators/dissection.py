"""Energies of networks that are larger than a task, by elimination in rounds.

A level can be taken out of a network without changing the others' solution: its lines to neighbours i, of weight w_i and with
x_v - x_i = d_i, become lines between the neighbours of weight w_i w_j / sum(w) and with x_i - x_j = d_j - d_i.  So the rest of a
network is again lines, and weights are only multiplied and added.  Here this is done by rounds over tables of lines:

* ``peel``: levels with one or two neighbours, no two of them linked, leave together.  This is joins and aggregates only, so a hub with
  any number of leaves is no task's burden; chains shrink by a third or more a round.
* ``cluster``: what is left is dealt into clusters around random seeds, grown by frontier joins and split by hash above ``most`` levels.  A
  cluster's inner levels, whose neighbours are all in it, leave in one task (Schur complement on its border).  Then new seeds are
  drawn among the levels left, so clusters of one round join up in the next: a dissection tree from its leaves to its root.
* ``top``: when a component has at most ``most`` levels left, a task solves it.

Then stars are read backwards: a level is the weighted mean of what its neighbours say.  Every round is a table in the shared folder.

A task's work is bounded by ``most`` levels and their lines, but for the top of a component whose clusters no longer shrink: a network without
small separators fills up in any elimination.  ``solve_spread`` then takes it in one task if ``force``, else raises.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import weight
from ..session import written
from .frames import empty
from .kernels import DEGREES, Elimination, potentials
from .network import LINES, SPREAD, rooted

#: Levels of a cluster, and neighbours that a level may have when it leaves a cluster.
MOST, FILL = 20_000, 64
#: Clusters are small where ``most`` is, so a task takes a lot of them: about so many levels, or ``most`` if that is more.
LOT, TASK = 20_000, ["net", "lot"]
#: Peeling ends when a round takes fewer than one level in ``WORTH``.
WORTH = 20
#: Rounds in which clusters grow.
GROWTH = 8

log = logging.getLogger(__name__)


def level_ids(transitions: DataFrame) -> DataFrame:
    """(net, level, id): a level is named by its first end, seq * 2 + side; ids follow the order of first appearance."""
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("upper").alias("level")), F.struct(F.lit(1).alias("side"), F.col("lower").alias("level")))
    return transitions.select("net", "seq", F.inline(both)).groupBy("net", "level").agg(F.min(F.col("seq") * 2 + F.col("side")).alias("id"))


def merged(lines: DataFrame) -> DataFrame:
    """Lines between the same two levels as one, a < b: weights add up, d is the weighted mean."""
    turned = F.when(F.col("a") > F.col("b"), -F.col("d")).otherwise(F.col("d"))
    ordered = lines.where("a <> b").select("net", "root", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", turned.alias("d"))
    return ordered.groupBy("net", "root", "a", "b").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("d"))


def both_ways(lines: DataFrame) -> DataFrame:
    """(net, root, v, o, w, d): each line from either end, d being x_v - x_o."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("o"), "w", "d"), F.struct(F.col("b").alias("v"), F.col("a").alias("o"), "w", (-F.col("d")).alias("d")))
    return lines.select("net", "root", F.inline(ends))


def peel(lines: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(stars, lines left): levels with one or two neighbours, no two of them linked, leave."""
    # numbers alone, which are added up in hash tables; lines are merged, so two neighbours differ
    ends = [f("o").alias(f"o{i}") for i, f in ((1, F.min), (2, F.max))] + [f(c, "o").alias(f"{c}{i}") for i, f in ((1, F.min_by), (2, F.max_by)) for c in ("w", "d")]
    few = both_ways(lines).groupBy("net", "root", "v").agg(F.count("*").alias("k"), *ends).where("k <= 2")
    named = [F.struct(F.col(f"o{i}").alias("o"), F.col(f"w{i}").alias("w"), F.col(f"d{i}").alias("d")).alias(f"n{i}") for i in (1, 2)]
    # of two linked levels with one hash neither leaves; the next round draws anew
    few = written(few.select("net", "root", "v", "k", *named, F.xxhash64("net", "v", F.lit(number)).alias("turn")), "few")
    rivals = few.select("net", "v", F.explode(F.array("n1.o", "n2.o")).alias("o")).join(few.select("net", F.col("v").alias("o"), F.col("turn").alias("other")), ["o", "net"])
    first = few.join(rivals.groupBy("net", "v").agg(F.min("other").alias("other")), ["v", "net"], "left").where(F.col("other").isNull() | (F.col("turn") < F.col("other")))
    stars = written(first.select("net", "root", "v", "k", "n1", "n2"), "stars")
    gone = stars.select("net", "v")
    rest = lines.join(gone.withColumnRenamed("v", "a"), ["a", "net"], "left_anti").join(gone.withColumnRenamed("v", "b"), ["b", "net"], "left_anti")
    w1, w2 = F.col("n1.w"), F.col("n2.w")
    new = stars.where("k = 2").select("net", "root", F.col("n1.o").alias("a"), F.col("n2.o").alias("b"), (w1 * w2 / (w1 + w2)).alias("w"), (F.col("n2.d") - F.col("n1.d")).alias("d"))
    return stars, written(merged(rest.unionByName(new)), "lines")


def _peeled_back(stars: DataFrame, x: DataFrame) -> DataFrame:
    """(net, v, x) of the levels that left in a round of ``peel``."""
    keyed = stars.select("net", "v", "k", F.col("n1.o").alias("o1"), "n1", "n2", F.col("n2.o").alias("o2"))
    at = lambda i: x.select("net", F.col("v").alias(f"o{i}"), F.col("x").alias(f"x{i}"))
    found = keyed.join(at(1), ["o1", "net"]).join(at(2), ["o2", "net"])
    w1, w2, p1, p2 = F.col("n1.w"), F.col("n2.w"), F.col("x1") + F.col("n1.d"), F.col("x2") + F.col("n2.d")
    return found.select("net", "v", F.when(F.col("k") == 1, p1).otherwise((w1 * p1 + w2 * p2) / (w1 + w2)).alias("x"))


def clusters(lines: DataFrame, most: int, number: int) -> DataFrame:
    """(net, v, c, s): the cluster of each level, none of more than about ``most`` levels.

    Seeds are drawn by hash, one in ``most`` / 4 levels; levels beside a cluster join one a round.  What no cluster reached is dealt by hash, and so are
    the levels of a cluster that has grown too large.
    """
    near = written(both_ways(lines).select("net", "v", "o"), "near")
    nodes = written(near.select("net", "v").distinct(), "nodes")
    drawn = F.pmod(F.xxhash64("net", "v", F.lit(number), F.lit("seed")), F.lit(max(1, most // 4))) == 0
    labels = written(nodes.where(drawn).select("net", "v", F.col("v").alias("c")), "labels")
    for _ in range(GROWTH):
        met = near.join(labels.select("net", F.col("v").alias("o"), "c"), ["o", "net"]).groupBy("net", "v").agg(F.min_by("c", F.xxhash64("c", F.lit(number))).alias("c"))
        new = written(met.join(labels, ["v", "net"], "left_anti"), "labels")
        if not new.count():
            break
        labels = labels.unionByName(new.select("net", "v", "c"))
    every = nodes.join(labels, ["v", "net"], "left").withColumn("c", F.coalesce("c", F.lit(-1)))
    sizes = every.groupBy("net", "c").agg(F.ceil(F.count("*") / F.lit(most)).alias("parts"))
    return written(every.join(sizes, ["net", "c"]).select("net", "v", "c", F.pmod(F.xxhash64("v", F.lit(number)), F.col("parts")).cast("int").alias("s")), "clusters")


def take_out(n: int, a, b, w, d, may_go: np.ndarray, fill: int = FILL):
    """(lines left, stars) of one cluster: levels that may go leave in rounds, few neighbours first, none with more than ``fill``.

    Lines are arrays (a, b, w, d) with one line for each pair; a star is (v, neighbours, shares, steps, weight of all), rows of levels of one degree.
    """
    stars = []
    turn = (np.arange(n) * 2654435761 >> 5) % (1 << 20)
    while True:
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        can = may_go & (degree > 0) & (degree <= fill)
        if not can.any():
            return (a, b, w, d), stars
        bound = next(k for k in (*DEGREES, fill) if k >= degree[can].min())
        can &= degree <= bound
        rank = np.where(can, degree, fill + 1) * (1 << 20) + turn
        rank = np.argsort(np.argsort(rank, kind="stable"))
        low = np.full(n, n)
        np.minimum.at(low, a, rank[b])
        np.minimum.at(low, b, rank[a])
        out = can & (rank < low)
        hit_a, hit_b = out[a], out[b]
        hit = hit_a | hit_b
        v, o, wt, step = np.where(hit_a, a, b)[hit], np.where(hit_a, b, a)[hit], w[hit], np.where(hit_a, d, -d)[hit]
        order = np.argsort(v, kind="stable")
        v, o, wt, step = v[order], o[order], wt[order], step[order]
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(starts, append=len(v))
        new = [(a[~hit], b[~hit], w[~hit], d[~hit])]
        for k in np.unique(size).tolist():
            rows = starts[size == k][:, None] + np.arange(k)
            ends, part, dist = o[rows], wt[rows], step[rows]
            total = part.sum(axis=1, keepdims=True)
            stars.append((v[rows[:, 0]], ends, part / total, dist, total[:, 0]))
            i, j = np.triu_indices(k, 1)
            new.append(tuple(x.ravel() for x in (ends[:, i], ends[:, j], part[:, i] * part[:, j] / total, dist[:, j] - dist[:, i])))
        a, b, w, d = (np.concatenate(x) for x in zip(*new))
        flip = a > b
        a, b, d = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, -d, d)
        key, back = np.unique(a * n + b, return_inverse=True)
        total = np.bincount(back, weights=w, minlength=len(key))
        d = np.bincount(back, weights=w * d, minlength=len(key)) / np.where(total > 0, total, 1)
        a, b, w = key // n, key % n, total


_OUT = "net string, root long, lot int, step int, a long, b long, w double, d double, total double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _inner_out(lines: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
    """Of a lot of clusters: lines left (step -1) and stars (a leaves, b is a neighbour, w its share), in order of their step.

    Clusters of a lot share no level, so they are taken apart as one network.  Of a whole component the last level stays, as it has no neighbour then.
    """
    if not len(lines):
        return empty(*_NAMES)
    names, ends = np.unique(np.concatenate([lines["a"].to_numpy(), lines["b"].to_numpy()]), return_inverse=True)
    m, n = len(lines), len(names)
    root = np.zeros(n, dtype=np.int64)
    root[ends[:m]] = root[ends[m:]] = lines["root"].to_numpy()
    may_go = ~np.isin(names, border["v"].to_numpy())
    left, stars = take_out(n, ends[:m], ends[m:], lines["w"].to_numpy(), lines["d"].to_numpy(), may_go)
    rows = [(root[left[0]], np.full(len(left[0]), -1), names[left[0]], names[left[1]], left[2], left[3], left[2])]
    for i, (v, o, share, step, total) in enumerate(stars):
        each = np.repeat(v, o.shape[1])
        rows.append((root[each], np.full(o.size, i), names[each], names[o.ravel()], share.ravel(), step.ravel(), np.repeat(total, o.shape[1])))
    out = pd.DataFrame(dict(zip(["root", *_NAMES[3:]], (np.concatenate(x) for x in zip(*rows)))))
    return out.assign(net=lines["net"].iloc[0], lot=lines["lot"].iloc[0])[_NAMES]


def cluster_round(lines: DataFrame, most: int, number: int) -> tuple[DataFrame, DataFrame]:
    """(stars, lines left): inner levels of clusters leave, a lot of clusters in one task.  Stars have their lots' lines left with them, at step -1."""
    of = clusters(lines, most, number)
    lots = of.groupBy("net").agg(F.ceil(F.count("*") / F.lit(max(most, LOT))).alias("lots"))
    of = of.join(F.broadcast(lots), "net").withColumn("lot", F.pmod(F.xxhash64("c", "s", F.lit(number)), F.col("lots")).cast("int"))
    end = lambda e: of.select("net", F.col("v").alias(e), F.struct("c", "s", "lot").alias(f"c{e}"))
    placed = written(lines.join(end("a"), ["a", "net"]).join(end("b"), ["b", "net"]), "placed")
    inside = placed.where("ca = cb").select("net", "root", "ca.lot", "a", "b", "w", "d")
    across = placed.where("ca <> cb")
    border = across.select("net", F.inline(F.array(F.struct("ca.lot", F.col("a").alias("v")), F.struct("cb.lot", F.col("b").alias("v"))))).distinct()
    out = written(inside.groupBy(*TASK).cogroup(border.groupBy(*TASK)).applyInPandas(_inner_out, _OUT), "cluster-out")
    left = out.where("step < 0").select("net", "root", "a", "b", "w", "d")
    return out, written(merged(left.unionByName(across.select(*left.columns))), "lines")


def _stars_back(stars: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    if not len(stars):
        return empty("net", "v", "x")
    names, at = np.unique(np.concatenate([stars["a"].to_numpy(), stars["b"].to_numpy()]), return_inverse=True)
    m = len(stars)
    x = np.full(len(names), np.nan)
    x[np.searchsorted(names, known["v"].to_numpy())] = known["x"].to_numpy()
    order = np.lexsort((at[:m], -stars["step"].to_numpy()))
    v, o, share, d, step = at[:m][order], at[m:][order], stars["w"].to_numpy()[order], stars["d"].to_numpy()[order], stars["step"].to_numpy()[order]
    for part in np.split(np.arange(m), np.flatnonzero(np.diff(step)) + 1):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(v[part]) != 0]))
        x[v[part][starts]] = np.add.reduceat(share[part] * (x[o[part]] + d[part]), starts)
    left = np.unique(at[:m])
    return pd.DataFrame({"net": stars["net"].iloc[0], "v": names[left], "x": x[left]})


def _clusters_back(stars: DataFrame, x: DataFrame) -> DataFrame:
    """(net, v, x) of the levels that left in a round of clusters."""
    stars = stars.where("step >= 0")
    asked = stars.select(*TASK, F.col("b").alias("v")).distinct().join(x, ["v", "net"])
    return stars.groupBy(*TASK).cogroup(asked.toDF(*asked.columns).groupBy(*TASK)).applyInPandas(_stars_back, "net string, v long, x double")


def _top_of(pdf: pd.DataFrame) -> pd.DataFrame:
    names, ends = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
    m = len(pdf)
    x = potentials(len(names), ends[:m], ends[m:], pdf["d"].to_numpy(), pdf["w"].to_numpy())
    return pd.DataFrame({"net": pdf["net"].iloc[0], "v": names, "x": x})


def _numbered_levels(ids: DataFrame) -> DataFrame:
    """Adds ``idx``, the place of a level in its net, by counts of chunks: no task sees a whole net."""
    chunk = F.shiftright("id", 16)
    place = F.row_number().over(Window.partitionBy("net", "chunk").orderBy("id"))
    cut = ids.withColumn("chunk", chunk).withColumn("place", place)
    sizes = cut.groupBy("net", "chunk").agg(F.count("*").alias("n"))
    before = sizes.select("net", "chunk", (F.sum("n").over(Window.partitionBy("net").orderBy("chunk")) - F.col("n")).alias("before"))
    return cut.join(before, ["net", "chunk"]).withColumn("idx", (F.col("before") + F.col("place") - 1).cast("int")).drop("chunk", "place", "before")


class Eliminated:
    """A network taken apart: ``levels`` (net, level, id, root), ``rounds`` of stars, the lines of the ``top`` and the lines it began with."""

    def __init__(self, transitions: DataFrame, unc: str, most: int, force: bool):
        ids = written(level_ids(transitions), "ids")
        named = lambda e, to: ids.select("net", F.col("level").alias(e), F.col("id").alias(to))
        checked = F.when(F.col(unc) == 0, F.raise_error(F.lit("an uncertainty is zero")).cast("double")).otherwise(weight(F.col(unc)))
        raw = transitions.select("net", "seq", "upper", "lower", checked.alias("w"), F.col("freq").alias("d")).join(named("upper", "a"), ["net", "upper"]).join(named("lower", "b"), ["net", "lower"])
        self.raw = written(raw.select("net", "seq", "a", "b", "w", "d"), "raw")
        links = self.raw.select("net", F.col("a").alias("upper"), F.col("b").alias("lower"))
        blocks = links.groupBy("net").agg(F.greatest(F.lit(SPREAD), F.ceil(F.count("*") / F.lit(LINES))).cast("int").alias("parts"))
        rows, tops = rooted(links, written(blocks, "sizes"), rounds=True)
        both = F.array(F.struct(F.col("upper").alias("id"), "node"), F.struct(F.col("lower").alias("id"), "node"))
        nodes = rows.select("net", F.inline(both)).groupBy("net", "id").agg(F.min("node").alias("node"))
        roots = nodes.join(tops, ["node", "net"], "left").select("net", "id", F.coalesce("_top", "node").alias("root"))
        self.levels = written(ids.join(roots, ["id", "net"]).select("net", "level", "id", "root"), "levels")
        self.rounds: list[tuple[str, DataFrame]] = []
        lines = written(merged(self.raw.join(self.levels.select("net", F.col("id").alias("a"), "root"), ["a", "net"])), "lines")
        self.top = self._clustered(self._peeled(lines), most, force)

    def _peeled(self, lines: DataFrame) -> DataFrame:
        for number in range(200):
            stars, rest = peel(lines, number)
            n, before = stars.count(), lines.count()
            if n:
                self.rounds.append(("peel", stars))
                lines = rest
                log.info("peel %d: %d levels left, %d lines before", number, n, before)
            if n * WORTH <= before:
                break
        return lines

    def _clustered(self, lines: DataFrame, most: int, force: bool) -> DataFrame:
        for number in range(200):
            nodes = both_ways(lines).select("net", "root", "v").distinct().groupBy("net", "root").agg(F.count("*").alias("n"))
            large = written(nodes.where(F.col("n") > most), "large")
            total = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if not total:
                break
            big = large.select("net", "root")
            stars, rest = cluster_round(written(lines.join(big, ["net", "root"], "left_semi"), "big"), most, number)
            n = stars.where("step >= 0").select("net", "a").distinct().count()
            log.info("clusters %d: %d of %d levels left", number, n, total)
            if n:
                self.rounds.append(("clusters", stars))
                lines = written(lines.join(big, ["net", "root"], "left_anti").unionByName(rest), "lines")
            if n * 20 < total:
                if not force:
                    raise ValueError(f"{total - n} levels are left that clusters of {most} levels can't take out")
                break
        return lines

    def taken(self) -> list[DataFrame]:
        """(net, v) of the levels that left in each round."""
        return [stars.select("net", "v") if kind == "peel" else stars.where("step >= 0").select("net", F.col("a").alias("v")).distinct() for kind, stars in self.rounds]


def solve_spread(transitions: DataFrame, *, unc: str = "unc", most: int = MOST, force: bool = True) -> DataFrame:
    """(net, comp, idx, level, energy): what ``solve.solve_energies`` gives, for networks of any number of levels.

    A task takes at most about ``most`` levels, but for what clusters can't take out any more (see above).  An uncertainty of zero raises.
    """
    e = Eliminated(transitions, unc, most, force)
    top = written(e.top.groupBy("net", "root").applyInPandas(_top_of, "net string, v long, x double"), "top")
    alone = e.levels.select("net", F.col("id").alias("v"))
    for t in (top.select("net", "v"), *e.taken()):
        alone = alone.join(t, ["v", "net"], "left_anti")
    known = [top, written(alone.withColumn("x", F.lit(0.0)), "alone")]
    for kind, stars in reversed(e.rounds):
        back = _peeled_back if kind == "peel" else _clusters_back
        known.append(written(back(stars, reduce(DataFrame.unionByName, known)), "x"))

    x = written(e.levels.join(reduce(DataFrame.unionByName, known).withColumnRenamed("v", "id"), ["id", "net"]), "x")
    parts = x.groupBy("net", "root").agg(F.min("x").alias("low"), F.count("*").alias("n"), F.min("id").alias("first"))
    ranked = parts.withColumn("comp", F.row_number().over(Window.partitionBy("net").orderBy(F.desc("n"), "first")))
    out = _numbered_levels(x.select("net", "id", "level", "root", "x")).join(ranked, ["net", "root"])
    return out.select("net", "comp", "idx", "level", (F.col("x") - F.col("low")).alias("energy"))


def _top_resistances(pdf: pd.DataFrame) -> pd.DataFrame:
    names, ends = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
    m = len(pdf)
    r = Elimination(len(names), ends[:m], ends[m:], pdf["w"].to_numpy()).resistances(ends[:m], ends[m:])
    return pd.DataFrame({"net": pdf["net"].iloc[0], "a": pdf["a"].to_numpy(), "b": pdf["b"].to_numpy(), "r": r})


def _ordered(net, v, o, r) -> list:
    return [net, F.least(v, o).alias("a"), F.greatest(v, o).alias("b"), r.alias("r")]


def _peeled_resistances(stars: DataFrame, known: DataFrame) -> DataFrame:
    """(net, a, b, r) between levels that left in a round of ``peel`` and their neighbours.

    A level v with shares s of neighbours i and weight W has R_vj = 1 / W + sum s_i R_ij - sum s_i s_k R_ik / 2.
    """
    v, o1, o2, w1, w2 = F.col("v"), F.col("n1.o"), F.col("n2.o"), F.col("n1.w"), F.col("n2.w")
    one = stars.where("k = 1").select(*_ordered("net", v, o1, 1 / w1))
    keyed = stars.where("k = 2").withColumn("a", F.least(o1, o2)).withColumn("b", F.greatest(o1, o2)).join(known, ["a", "b", "net"])
    total = w1 + w2
    each = lambda o, other: F.struct(F.least(v, o).alias("a"), F.greatest(v, o).alias("b"), (1 / total + other * other / (total * total) * F.col("r")).alias("r"))
    return one.unionByName(keyed.select("net", F.inline(F.array(each(o1, w2), each(o2, w1)))))


def _resistances_back(stars: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    stars = stars[stars["step"] >= 0]
    if not len(stars):
        return empty("net", "a", "b", "r")
    names = np.unique(np.concatenate([stars["a"].to_numpy(), stars["b"].to_numpy(), known["a"].to_numpy(), known["b"].to_numpy()]))
    n, at = len(names), lambda c: np.searchsorted(names, c.to_numpy())
    keys, values = at(known["a"]) * n + at(known["b"]), known["r"].to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    v, o, share, total, step = at(stars["a"]), at(stars["b"]), stars["w"].to_numpy(), stars["total"].to_numpy(), stars["step"].to_numpy()
    new_keys, new_values = [], []
    for i in np.unique(step)[::-1]:
        mine = np.flatnonzero(step == i)
        mine = mine[np.argsort(v[mine], kind="stable")]
        d = len(mine) // len(np.unique(v[mine]))  # levels of one step have as many neighbours
        rows = mine.reshape(-1, d)
        ends, s, me = o[rows], share[rows], v[rows[:, 0]]
        r = np.zeros((len(rows), d, d))
        if d > 1:
            p, q = np.triu_indices(d, 1)
            asked = np.minimum(ends[:, p], ends[:, q]) * n + np.maximum(ends[:, p], ends[:, q])
            r[:, p, q] = r[:, q, p] = values[np.searchsorted(keys, asked)]
        to = np.einsum("vi,vij->vj", s, r)
        found = 1 / total[rows[:, 0]][:, None] + to - np.einsum("vj,vj->v", s, to)[:, None] / 2
        key = (np.minimum(me[:, None], ends) * n + np.maximum(me[:, None], ends)).ravel()
        new_keys.append(key)
        new_values.append(found.ravel())
        order = np.argsort(np.concatenate([keys, key]), kind="stable")
        keys, values = np.concatenate([keys, key])[order], np.concatenate([values, found.ravel()])[order]
    key = np.concatenate(new_keys)
    return pd.DataFrame({"net": stars["net"].iloc[0], "a": names[key // n], "b": names[key % n], "r": np.concatenate(new_values)})


def leverages_spread(transitions: DataFrame, *, unc: str = "unc", most: int = MOST, force: bool = True) -> DataFrame:
    """(net, seq, leverage): weight times effective resistance of each line, for networks of any number of levels; 0 for a self-loop.

    The rounds of ``solve_spread`` are read backwards for the resistances between a level and its neighbours at the time it left; those between the
    neighbours are known then, as leaving linked them.
    """
    e = Eliminated(transitions, unc, most, force)
    known = written(e.top.groupBy("net", "root").applyInPandas(_top_resistances, "net string, a long, b long, r double"), "resistances")
    for kind, stars in reversed(e.rounds):
        if kind == "peel":
            new = _peeled_resistances(stars, known)
        else:
            linked = stars.where("step < 0").select(*TASK, "a", "b").join(known, ["a", "b", "net"])
            new = stars.groupBy(*TASK).cogroup(linked.toDF(*linked.columns).groupBy(*TASK)).applyInPandas(_resistances_back, "net string, a long, b long, r double")
        known = known.unionByName(written(new, "resistances"))
    pair = e.raw.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).select("net", "seq", "w", F.col("lo").alias("a"), F.col("hi").alias("b"))
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("w") * F.col("r"), F.lit(0.0))))
    return pair.join(known, ["a", "b", "net"], "left").select("net", "seq", h.alias("leverage"))
