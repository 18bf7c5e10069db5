"""Simulated defects: masked lines, corrupted lines, detached subtrees, sampled pairs.

Random choices are hashes of (seed, net, copy, line), so they are the same under any partitioning, on any engine and on reruns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ERROR_SCALE, copy_key, hashed, hashes, shifted, token_int, uniform
from . import kernels
from .frames import empty
from .solve import _numbered, _weights, n_blocks, residuals, sample_blocks

CLEAN, FREQ_SHIFT, QN_BUMP = 0, 1, 2
#: Shifts are between these many uncertainties.
SHIFT_FROM, SHIFT_TO = 5.0, 500.0


def n_chosen(fraction: float, total: Column) -> Column:
    """At least one; halves go to the even neighbour."""
    return F.greatest(F.lit(1), F.bround(F.lit(fraction) * total, 0).cast("int"))


def chosen(rows: DataFrame, fraction: float, seed, *keys: str) -> DataFrame:
    """Adds ``picked``: a fraction of the lines of each key, without replacement, by order of hash."""
    by = Window.partitionBy(*keys)
    h = hashed(seed, *[F.col(k) for k in keys], F.col("seq"))
    place = F.row_number().over(by.orderBy("_h", "seq"))
    total = F.count("*").over(by)
    return rows.withColumn("_h", h).withColumn("picked", place <= n_chosen(fraction, total)).drop("_h")


def copies(transitions: DataFrame, n: int) -> DataFrame:
    return transitions.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def corrupt(transitions: DataFrame, *, fraction: float = 0.05, seed: int = 0, j_pos: int = 1) -> DataFrame:
    """Lines with ``kind``, ``mag`` and ``orig_upper``; keyed by (net, copy), copy 0 if there is none.

    A chosen line gets, by even odds, J of its upper level moved by one (either sign first, then the other, if J stays at 0 or more
    and the level is not the lower one), or its frequency moved by 5 to 500 uncertainties, log-uniform; the latter also if no move
    is possible.
    """
    rows = transitions if "copy" in transitions.columns else transitions.withColumn("copy", F.lit(0))
    rows = chosen(rows, fraction, seed, "net", "copy")
    draw = lambda what: uniform(seed, what, F.col("net"), F.col("copy"), F.col("seq"))
    sign = F.when(draw("sign") < 0.5, -1).otherwise(1)
    j = token_int(F.col("upper"), j_pos)

    def bumped(d: Column) -> Column:
        level = shifted(F.col("upper"), j_pos, d)
        return F.when((j + d >= 0) & (level != F.col("lower")), level)

    new_upper = F.when(F.col("picked") & (draw("mode") < 0.5), F.coalesce(bumped(sign), bumped(-sign)))
    rows = rows.withColumn("new_upper", new_upper)
    kind = F.when(~F.col("picked"), CLEAN).when(F.col("new_upper").isNotNull(), QN_BUMP).otherwise(FREQ_SHIFT).cast("tinyint")
    lo, hi = np.log10(SHIFT_FROM), np.log10(SHIFT_TO)
    mag = F.when(F.col("kind") == FREQ_SHIFT, F.pow(F.lit(10.0), F.lit(float(lo)) + draw("mag") * F.lit(float(hi - lo)))).otherwise(0.0)
    way = F.when(draw("way") < 0.5, -1.0).otherwise(1.0)
    rows = rows.withColumn("kind", kind).withColumn("mag", mag)
    return rows.select(
        "net", "copy", "seq", (F.col("freq") + F.when(F.col("kind") == FREQ_SHIFT, way * F.col("unc") * F.col("mag")).otherwise(0.0)).alias("freq"), "unc", "orig_unc",
        F.coalesce("new_upper", "upper").alias("upper"), "lower", "ref", "kind", "mag", F.col("upper").alias("orig_upper"),
    )


def main_of_copies(corrupted: DataFrame) -> DataFrame:
    """Largest component of each (net, copy), keyed as nets ``net#copy``; labels are columns and stay with their lines."""
    from .network import largest_component

    return largest_component(corrupted.withColumn("net", copy_key("net", "copy")))


def masked(transitions: DataFrame, *, n_samples: int = 200, mask_fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """Lines that each sample keeps: (net, sample, ...)."""
    fanned = transitions.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    return chosen(fanned, mask_fraction, seed, "net", "sample").where(~F.col("picked")).drop("picked")


def _refits(n_samples: int, mask_fraction: float, seed: int):
    step = n_blocks(n_samples)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, levels, u, l = _numbered(pdf)  # noqa: E741
        net, freq, seq = pdf["net"].iloc[0], pdf["freq"].to_numpy(), pdf["seq"].to_numpy()
        weights, ground = _weights(pdf["unc"].to_numpy()), int(np.flatnonzero(levels == pdf["ground"].iloc[0])[0])
        given = np.zeros(len(levels))
        given[u], given[l] = pdf["e_upper"].to_numpy(), pdf["e_lower"].to_numpy()
        n_masked = max(1, round(mask_fraction * len(pdf)))  # halves go to the even neighbour, here as in ``n_chosen``
        parts = []
        for sample in range(int(pdf["block"].iloc[0]), n_samples, step):
            kept = np.ones(len(pdf), dtype=bool)
            kept[np.lexsort((seq, np.array(hashes(seq.tolist(), seed, net, sample))))[:n_masked]] = False
            label = kernels.components(len(levels), u[kept], l[kept])
            mine = np.flatnonzero(kept & (label[u] == label[ground]))
            if not len(mine):
                continue
            nodes, ends_ = np.unique(np.concatenate([u[mine], l[mine]]), return_inverse=True)
            x = kernels.potentials(len(nodes), ends_[: len(mine)], ends_[len(mine) :], freq[mine], weights[mine])
            parts.append(pd.DataFrame({"net": net, "level": levels[nodes], "sample": sample, "err": (x - given[nodes]) * ERROR_SCALE}))
        return pd.concat(parts) if parts else empty("net", "level", "sample", "err")

    return run


def refit_errors(transitions: DataFrame, energies: DataFrame, *, n_samples: int = 200, mask_fraction: float = 0.15, seed: int = 0, lost: bool = False) -> DataFrame:
    """(net, level, sample, err): how far each level moves, in 1e-6/cm, when lines are masked; levels that lose the ground are absent.

    A sample's masked lines are those of ``masked``, drawn where a net's lines have met, so a line isn't shuffled once a sample.  A refit is shifted to its own minimum.  With ``lost``, absent levels have a row with a null error.  Nets are taken as connected:
    pass the main component.
    """
    ground = energies.groupBy("net").agg(F.min_by("level", F.struct("energy", "idx")).alias("ground"))
    lines = residuals(transitions, energies).join(ground, "net").select("net", "seq", "upper", "lower", "freq", "unc", "e_upper", "e_lower", "ground")
    refits = _refits(n_samples, mask_fraction, seed)
    found = sample_blocks(lines, n_samples).groupBy("net", "block").applyInPandas(refits, "net string, level string, sample int, err double")
    if not lost:
        return found
    every = energies.select("net", "level").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    return every.join(found, ["net", "level", "sample"], "left")


def without_ground(errors: DataFrame, energies: DataFrame) -> DataFrame:
    """``errors(net, level, ...)`` of all levels but each net's ground, which stays at 0 by construction."""
    from .solve import ground_levels

    return errors.join(ground_levels(energies).select("net", "level"), ["net", "level"], "left_anti")


def _hash32(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def _detach_of_net(n_detach: int, max_size: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, levels, u, l = _numbered(pdf)  # noqa: E741
        net, copy = pdf["net"].iloc[0], int(pdf["copy"].iloc[0])
        energy = np.zeros(len(levels))
        energy[u], energy[l] = pdf["e_upper"].to_numpy(), pdf["e_lower"].to_numpy()
        cut = kernels.bridges(len(levels), u, l)
        named = {tuple(sorted((levels[a], levels[b]))) for a, b in zip(u[cut].tolist(), l[cut].tolist())}
        links = sorted(named, key=lambda p: (_hash32(seed, net, copy, *p), p))
        at = {v: i for i, v in enumerate(levels)}
        picks, gone = kernels.detach(len(levels), u, l, int(energy.argmin()), [(at[a], at[b]) for a, b in links], n_detach, max_size)
        rows = [(net, copy, k, levels[v], levels[root], levels[anchor], anchor in gone) for k, (side, root, anchor) in enumerate(picks) for v in sorted(side)]
        return pd.DataFrame(rows, columns=["net", "copy", "orphan_id", "level", "orphan_level", "main_level", "void"])

    return run


def detached_levels(transitions: DataFrame, energies: DataFrame, *, n_copies: int = 1, n_detach: int = 5, max_size: int = 25, seed: int = 0) -> DataFrame:
    """(net, copy, orphan_id, level, orphan_level, main_level, void): levels of each bridge subtree that was cut off.

    Bridges are tried in order of hash; the side without the ground leaves if it has 2 to ``max_size`` levels.  A pick is void if its
    anchor left with a later one.  Nets are taken as connected.
    """
    lines = copies(residuals(transitions, energies), n_copies).select("net", "copy", "seq", "upper", "lower", "e_upper", "e_lower")
    schema = "net string, copy int, orphan_id int, level string, orphan_level string, main_level string, void boolean"
    return lines.groupBy("net", "copy").applyInPandas(_detach_of_net(n_detach, max_size, seed), schema)


def detached_parts(transitions: DataFrame, detached: DataFrame, *, n_copies: int = 1) -> DataFrame:
    """Lines of each copy with ``part`` (main, orphan, dropped, bridge) and ``orphan_id``; a cut line is in neither part."""
    up = detached.select("net", "copy", F.col("level").alias("upper"), F.col("orphan_id").alias("o_up"), "void")
    low = detached.select("net", "copy", F.col("level").alias("lower"), F.col("orphan_id").alias("o_low"))
    rows = copies(transitions, n_copies).join(up, ["net", "copy", "upper"], "left").join(low, ["net", "copy", "lower"], "left")
    inside = F.col("o_up") == F.col("o_low")
    part = F.when(F.col("o_up").isNull() & F.col("o_low").isNull(), "main").when(inside & F.col("void"), "dropped").when(inside, "orphan").otherwise("bridge")
    return rows.withColumn("part", part).withColumn("orphan_id", F.when(inside, F.col("o_up"))).drop("o_up", "o_low", "void")


def orphans(detached: DataFrame) -> DataFrame:
    """(net, copy, orphan_id, orphan_level, main_level): cut links to be found again; void picks have none."""
    return detached.where(~F.col("void")).select("net", "copy", "orphan_id", "orphan_level", "main_level").distinct()


def negative_pairs(orphan_links: DataFrame, orphan_levels: DataFrame, main_levels: DataFrame, *, n_neg: int = 100, seed: int = 0) -> DataFrame:
    """(net, copy, orphan_id, k, orphan_level, main_level, label): the true pair (k = -1) and ``n_neg`` uniform ones, with replacement.

    Levels are numbered per orphan and per main part, and picks are numbers, so no pairs are listed out.
    """
    key = ["net", "copy", "orphan_id"]
    o = orphan_levels.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("level")) - 1)
    m = main_levels.withColumn("j", F.row_number().over(Window.partitionBy("net", "copy").orderBy("level")) - 1)
    sizes = orphan_links.select(*key).join(o.groupBy(*key).agg(F.count("*").alias("n_o")), key).join(m.groupBy("net", "copy").agg(F.count("*").alias("n_m")), ["net", "copy"])
    drawn = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_neg - 1))))
    pick = lambda what, n: F.pmod(hashed(seed, what, *[F.col(c) for c in key], F.col("k")), F.col(n))
    drawn = drawn.withColumn("i", pick("o", "n_o")).withColumn("j", pick("m", "n_m"))
    pairs = drawn.join(o.select(*key, "i", F.col("level").alias("orphan_level")), [*key, "i"]).join(m.select("net", "copy", "j", F.col("level").alias("main_level")), ["net", "copy", "j"])
    false = pairs.select(*key, "k", "orphan_level", "main_level", F.lit(0).alias("label"))
    return orphan_links.select(*key, F.lit(-1).alias("k"), "orphan_level", "main_level", F.lit(1).alias("label")).unionByName(false)
