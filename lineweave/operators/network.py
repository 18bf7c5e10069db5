"""Decomposition of transition networks: level index, components, simple graph, edge lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import COMPONENTS
from ..session import written
from . import kernels

#: Lines of a net that a task takes at once, blocks of smaller nets where spreading is asked for, and links of blocks that one task settles, there too.
LINES, SPREAD, LINKS, SHARD = 100_000, 8, 4_000_000, 1_000_000
#: Nodes of a block are numbered below this.
NODES = 1 << 40


def ends(transitions: DataFrame, *keep: str) -> DataFrame:
    """Two rows a line, one for each end: (net, seq, side, level, ...); side 0 is the upper level."""
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("upper").alias("level")), F.struct(F.lit(1).alias("side"), F.col("lower").alias("level")))
    return transitions.select("net", "seq", *keep, F.inline(both))


def level_index(transitions: DataFrame) -> DataFrame:
    """(net, level, idx): levels numbered from 0 in order of first appearance, upper before lower in a line."""
    first = ends(transitions).groupBy("net", "level").agg(F.min(F.struct("seq", "side")).alias("first"))
    return first.select("net", "level", (F.row_number().over(Window.partitionBy("net").orderBy("first")) - 1).alias("idx"))


def simple_edges(transitions: DataFrame) -> DataFrame:
    """(net, a, b): pairs of linked levels, parallel lines once, a < b; self-loops go."""
    pair = transitions.select("net", F.least("upper", "lower").alias("a"), F.greatest("upper", "lower").alias("b"))
    return pair.where("a <> b").distinct()


def bidirected(transitions: DataFrame, *keep: str) -> DataFrame:
    """Both directions of each line: (net, seq, dir, src, dst, ...); direction 0 is upper to lower."""
    both = F.array(
        F.struct(F.lit(0).alias("dir"), F.col("upper").alias("src"), F.col("lower").alias("dst")), F.struct(F.lit(1).alias("dir"), F.col("lower").alias("src"), F.col("upper").alias("dst"))
    )
    return transitions.select("net", "seq", *keep, F.inline(both))


def _of_net(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq", kind="stable")
    levels, u, l = kernels.number_levels(pdf["upper"].to_numpy(), pdf["lower"].to_numpy())  # noqa: E741
    rank, size = kernels.ranked_components(len(levels), u, l)
    return pd.DataFrame({"net": pdf["net"].iloc[0], "comp": rank, "n_levels": size, "idx": np.arange(len(levels)), "level": levels})


def _of_block(pdf: pd.DataFrame) -> pd.DataFrame:
    levels, u, l = kernels.number_levels(pdf["upper"].to_numpy(), pdf["lower"].to_numpy())  # noqa: E741
    root = kernels.components(len(levels), u, l)[u]
    fresh = np.zeros(2 * len(u), dtype=bool)
    fresh[np.unique(np.stack([u, l], axis=1).ravel(), return_index=True)[1]] = True
    return pdf.drop(columns="block").assign(node=pdf["block"].to_numpy(dtype=np.int64) * NODES + root, new_upper=fresh[0::2], new_lower=fresh[1::2])


def _of_links(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = kernels.components(len(nodes), at[: len(a)], at[len(a) :])
    return pd.DataFrame({"net": pdf["net"].iloc[0], "node": nodes, "_top": nodes[label]})


def sizes(lines: DataFrame, most: int) -> DataFrame | None:
    """(net, parts): how many tasks should share each net's lines; None if a task can take any net."""
    parts = written(lines.groupBy("net").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")), "sizes")
    return parts if (parts.agg(F.max("parts")).first()[0] or 1) > 1 else None


def rooted(lines: DataFrame, parts: DataFrame, *, rounds: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines with ``node``, tops of nodes): components of any net, no task having more than a block of its lines.

    Lines meet in blocks by their lower level, and components of a block become nodes; levels that are in several blocks link nodes.  Those
    links are numbers and few; they are settled by net.  Of a net with over ``LINKS`` of them (``SHARD`` if ``rounds`` asks for it) each task settles a shard of
    so many, and the stars of all shards go through star rounds, which read the whole table each time.  A node without links is missing from ``tops(net, node, _top)``: it is its own top.
    """
    block = F.pmod(F.xxhash64("lower"), F.col("parts")).cast("int")
    blocks = lines.join(F.broadcast(parts), "net").withColumn("block", block).drop("parts")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    rows = written(blocks.groupBy("net", "block").applyInPandas(_of_block, f"{fields}, node long, new_upper boolean, new_lower boolean"), "rooted")
    # a level once a block, so that none has more rows than there are blocks
    both = F.array(F.struct(F.col("new_upper").alias("new"), F.col("upper").alias("level")), F.struct(F.col("new_lower").alias("new"), F.col("lower").alias("level")))
    seen = rows.select("net", "node", F.inline(both)).where("new").withColumn("b", F.lag("node").over(Window.partitionBy("net", "level").orderBy("node")))
    links = written(seen.where("b <> node").select("net", F.col("node").alias("a"), "b").distinct(), "links")
    rows = rows.drop("new_upper", "new_lower")
    counts = written(links.groupBy("net").agg(F.ceil(F.count("*") / F.lit(SHARD if rounds else LINKS)).cast("int").alias("shards")), "counts")
    shape = "net string, node long, _top long"
    if (counts.agg(F.max("shards")).first()[0] or 0) <= 1:
        return rows, written(links.groupBy("net").applyInPandas(_of_links, shape), "tops")
    shard = F.pmod(F.xxhash64("a"), F.col("shards")).cast("int").alias("shard")
    stars = links.join(F.broadcast(counts), "net").select("net", "a", "b", shard).groupBy("net", "shard").applyInPandas(_of_links, shape)
    found = star_components(stars.select("net", F.col("node").alias("a"), F.col("_top").alias("b")), "net")
    return rows, found.withColumnRenamed("root", "_top")


def parted(transitions: DataFrame, *, most: int | None = None) -> DataFrame:
    """Lines with ``_part`` and ``_top`` where a net has more than ``most`` of them, else as they are.

    A part has whole components (``_top`` names them) and about ``most`` lines, more only if a component has.  What is solved component by
    component can be so by (net, _part).
    """
    if "_part" in transitions.columns:
        return transitions
    lines = written(transitions, "lines")  # read twice, and counted before
    parts = sizes(lines, most or LINES)
    if parts is None:
        return lines
    rows, tops = rooted(lines, parts)
    named = rows.join(tops, ["net", "node"], "left").withColumn("_top", F.coalesce("_top", "node")).drop("node")
    part = F.pmod(F.xxhash64("_top"), F.col("parts")).cast("int")
    return named.join(F.broadcast(parts), "net").withColumn("_part", part).drop("parts")


def keys(lines: DataFrame) -> list[str]:
    """What lines meet by to be solved: their net, or (net, _part) where nets are parted."""
    return ["net", "_part"] if "_part" in lines.columns else ["net"]


def firsts(lines: DataFrame, *keep: str) -> DataFrame:
    """(net, level, first, ...): place of each level's first appearance, and the least of other columns over its lines."""
    first = F.min(F.col("seq") * 2 + F.col("side")).alias("first")
    return ends(lines, *keep).groupBy("net", "level").agg(first, *[F.min(c).alias(c) for c in keep])


def ranks(levels: DataFrame) -> DataFrame:
    """(net, _top, comp, n_levels) of ``levels(net, _top, first)``: components by size, largest first, ties by first appearance."""
    counts = levels.groupBy("net", "_top").agg(F.count("*").cast("int").alias("n_levels"), F.min("first").alias("first"))
    return counts.select("net", "_top", F.row_number().over(Window.partitionBy("net").orderBy(F.desc("n_levels"), "first")).alias("comp"), "n_levels")


def ranked(levels: DataFrame) -> DataFrame:
    """Adds ``comp``, ``n_levels`` and ``idx`` to written ``levels(net, _top, first, ...)``; ``idx`` costs nothing if nobody reads it."""
    idx = (F.row_number().over(Window.partitionBy("net").orderBy("first")) - 1).cast("int")
    return levels.join(ranks(levels), ["net", "_top"]).withColumn("idx", idx).drop("_top", "first")


def components(transitions: DataFrame, *, method: str = "by_net", most: int | None = None) -> DataFrame:
    """(net, comp, n_levels, idx, level): component of each level; comp 1 is a net's largest, ties by first appearance.

    ``by_net`` takes each net in one task if it has at most ``most`` lines, and else a block of so many at a time; ``distributed`` always takes
    blocks, and fewer links of them a task (see :func:`rooted`).
    """
    return _components(transitions, method, most, False)


def _components(transitions: DataFrame, method: str, most: int | None, stored: bool) -> DataFrame:
    lines = transitions.select("net", "seq", "upper", "lower")
    if method not in ("by_net", "distributed"):
        raise ValueError(method)
    if "_part" in transitions.columns:
        levels = firsts(transitions.select("net", "seq", "upper", "lower", "_top"), "_top")
        return ranked(written(levels, "levels")).select("net", "comp", "n_levels", "idx", "level")
    lines = lines if stored else written(lines, "lines")
    parts = sizes(lines, most or LINES)
    if parts is None:
        if method == "by_net":
            return lines.groupBy("net").applyInPandas(_of_net, COMPONENTS)
        parts = lines.select("net", F.lit(SPREAD).alias("parts")).distinct()
    rows, tops = rooted(lines, parts, rounds=method == "distributed")
    levels = firsts(rows, "node").join(tops, ["net", "node"], "left").select("net", F.coalesce("_top", "node").alias("_top"), "first", "level")
    return ranked(written(levels, "levels")).select("net", "comp", "n_levels", "idx", "level")


def star_components(edges: DataFrame, *keys: str, max_rounds: int = 60) -> DataFrame:
    """(keys, node, root): smallest node of the component of each node of ``edges(keys, a, b)``; nodes are of any ordered type.

    Both ends of an edge share the ``keys``.  Nodes that are numbers are added up in hash tables and sorted by their own bits, which structs of key and
    number are not.  Large-star and small-star rounds, each over a table written to the shared folder, until the edges no longer change; rounds
    grow with the logarithm of the longest path, and a node's links are cut down to one before they could gather in a task.
    """
    by = ["a", *keys]
    now = written(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        up = now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
        low = now.select(*keys, "a", "b").unionByName(up).groupBy(*by).agg(F.min("b").alias("m")).select(*by, F.least("a", "m").alias("m"))
        large = up.join(low, by).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy(*by).agg(F.min("b").alias("m"))
        small = large.join(lowest, by).select(*keys, F.col("b").alias("x"), "m", "a")
        linked = small.select(*keys, F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select(*keys, "a", F.col("m").alias("b")))
        now = written(linked.where("a <> b").distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64(*by, "b").cast("decimal(20,0)"))).first()
        if new == state:
            return now.groupBy(*by).agg(F.min("b").alias("root")).select(*keys, F.col("a").alias("node"), "root")
        state = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _bridges_of_net(pdf: pd.DataFrame) -> pd.DataFrame:
    levels, u, l = kernels.number_levels(pdf["a"].to_numpy(), pdf["b"].to_numpy())  # noqa: E741
    return pdf.loc[kernels.bridges(len(levels), u, l), ["net", "a", "b"]]


def bridges(transitions: DataFrame, *, method: str = "by_net") -> DataFrame:
    """(net, a, b), a < b: links without which their network falls apart; lines between the same two levels count as one link.

    ``by_net`` takes each net in one task, or its parts (see :func:`parted`); ``distributed`` spreads a net over tasks (see :mod:`.forest`).
    """
    if method == "by_net":
        lines = parted(transitions)
        by = keys(lines)
        pair = lines.select(*by, F.least("upper", "lower").alias("a"), F.greatest("upper", "lower").alias("b")).where("a <> b").distinct()
        return pair.groupBy(*by).applyInPandas(_bridges_of_net, "net string, a string, b string")
    if method != "distributed":
        raise ValueError(method)
    from . import forest

    return forest.bridges(transitions)


def component_sizes(comps: DataFrame) -> DataFrame:
    return comps.groupBy("net", "comp").agg(F.count("*").cast("int").alias("n_levels"))


def _labelled(transitions: DataFrame, method: str) -> DataFrame:
    """Lines with their component; they are written first, as components and what is labelled read them."""
    lines = written(transitions, "given")
    return with_component(lines, _components(lines, method, None, True))


def with_component(transitions: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds ``comp`` and ``n_levels`` by the upper level; both ends of a line share a component."""
    return transitions.join(comps.select("net", F.col("level").alias("upper"), "comp", "n_levels"), ["net", "upper"])


def split_components(transitions: DataFrame, *, minsize: int = 1, method: str = "by_net") -> tuple[DataFrame, DataFrame]:
    """(solvable, dropped) lines with ``comp`` and ``n_levels``; components of fewer than ``minsize`` levels are dropped."""
    labelled = _labelled(transitions, method)
    return labelled.where(F.col("n_levels") >= minsize), labelled.where(F.col("n_levels") < minsize)


def largest_component(transitions: DataFrame, *, method: str = "by_net") -> DataFrame:
    """Lines of each net's largest component; whatever columns label a line stay with it."""
    return _labelled(transitions, method).where("comp = 1").select(*transitions.columns)


def neighbour_mean(transitions: DataFrame, values: DataFrame) -> DataFrame:
    """(net, level, mean): mean over lines of ``values(net, level, value)`` at the other end."""
    edges = bidirected(transitions).join(values.select("net", F.col("level").alias("src"), "value"), ["net", "src"])
    return edges.groupBy("net", F.col("dst").alias("level")).agg(F.avg("value").alias("mean"))


def is_connected(transitions: DataFrame, *, method: str = "by_net") -> DataFrame:
    """(net, connected)."""
    return components(transitions, method=method).groupBy("net").agg((F.max("comp") == 1).alias("connected"))
