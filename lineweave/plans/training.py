"""Preparing training samples, training, evaluation and advisory reports.

A sample is one network's arrays: the graph, and what a loss needs.  Samples are made by DataFrame operators over (net, copy) keys before
the loop; the loop only sums gradients over them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import copy_key, copy_parts
from ..operators import candidates, features, metrics, model, network, simulate, solve
from ..session import written


def _joined(samples: DataFrame, extra: DataFrame, merge) -> DataFrame:
    """Merges what ``extra(net, rows)`` has for a net into its sample."""

    def run(batches):
        for b in batches:
            out = [model.packed(merge(model.unpacked(s), r)) for s, r in zip(b["sample"], b["rows"])]
            yield pd.DataFrame({"net": b["net"], "sample": out})

    return samples.join(extra, "net", "left").select("net", "sample", "rows").mapInPandas(run, "net string, sample binary")


def _rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy("net").agg(F.collect_list(F.struct(*cols)).alias("rows"))


def main_components(transitions: DataFrame) -> DataFrame:
    solvable, _ = network.split_components(transitions, minsize=2)
    return solvable.where("comp = 1").select(*transitions.columns)


def refit_samples(transitions: DataFrame, *, n_samples: int = 200, seed: int = 0) -> DataFrame:
    """(net, sample): main component with refit errors of all levels but the ground, which stays at 0 by construction."""
    main = written(main_components(transitions), "main")
    energies = written(solve.solve_energies(main), "energies")
    nodes, edges = features.build_graph(main, energies)
    err = simulate.without_ground(simulate.refit_errors(main, energies, n_samples=n_samples, seed=seed), energies)
    err = err.join(energies.select("net", "level", "idx"), ["net", "level"])

    def merge(g, rows):
        rows = rows if rows is not None else []
        return g | {"err_level": np.array([r["idx"] for r in rows], dtype=np.int64), "err": np.array([r["err"] for r in rows], dtype=float)}

    return _joined(model.graphs(nodes, edges), _rows(err, "idx", "err"), merge)


def corrupted_samples(transitions: DataFrame, *, n_graphs: int = 30, fraction: float = 0.05, seed: int = 0, j_pos: int = 1) -> DataFrame:
    """(net, sample): corrupted copies, cut down to their main component, with bad lines and candidates of bumped ones."""
    main = main_components(transitions)
    bad = written(simulate.main_of_copies(simulate.corrupt(simulate.copies(main, n_graphs), fraction=fraction, seed=seed, j_pos=j_pos)), "bad")
    lines = bad.drop("copy")
    energies = written(solve.solve_energies(lines), "energies")
    nodes, edges = features.build_graph(lines, energies)
    cand = candidates.recoverable(candidates.correction_candidates(lines.where(F.col("kind") == simulate.QN_BUMP), energies, j_pos=j_pos))
    number = energies.select("net", "level", "idx")
    cand = cand.join(number.select("net", F.col("level").alias("cand_level"), F.col("idx").alias("cand")), ["net", "cand_level"])
    cand = cand.groupBy("net", "seq").agg(F.sort_array(F.collect_list(F.struct("pos", "cand", "dj_upper", "dj_lower", "mismatch", F.col("is_target").cast("int").alias("y")))).alias("window"))
    per = lines.select("net", "seq", (F.col("kind") > 0).cast("int").alias("bad")).join(cand, ["net", "seq"], "left")

    def merge(g, rows):
        rows = sorted(rows, key=lambda r: r["seq"])
        y = np.array([r["bad"] for r in rows], dtype=float)
        flat = [(k, s, c) for s, (k, r) in enumerate((k, r) for k, r in enumerate(rows) if r["window"] is not None) for c in r["window"]]
        line = np.array([k for k, _, _ in flat], dtype=np.int64)
        return g | {
            "bad": y, "pos_weight": float((1 - y).sum() / max(y.sum(), 1)), "suspect": np.array([s for _, s, _ in flat], dtype=np.int64), "cand": np.array([c["cand"] for *_, c in flat], dtype=np.int64),
            "target": np.array([c["y"] for *_, c in flat], dtype=np.int64), "lower": g["ends"][1, 0::2][line], "line_attr": g["attr"][0::2][line],
            "extras": np.array([[c["dj_upper"], c["dj_lower"], c["mismatch"]] for *_, c in flat], dtype=float).reshape(-1, model.EXTRAS),
        }

    return _joined(model.graphs(nodes, edges), _rows(per, "seq", "bad", "window"), merge)


def linked_samples(transitions: DataFrame, *, n_graphs: int = 30, n_detach: int = 5, max_size: int = 25, n_neg: int = 100, seed: int = 0) -> DataFrame:
    """(net, sample): copies with subtrees cut off, each orphan with its true link and random ones; copies without orphans go."""
    main = written(main_components(transitions), "main")
    energies = solve.solve_energies(main)
    cut = written(simulate.detached_levels(main, energies, n_copies=n_graphs, n_detach=n_detach, max_size=max_size, seed=seed), "cut")
    parts = written(simulate.detached_parts(main, cut, n_copies=n_graphs), "parts")
    names = ["seq", "freq", "unc", "orig_unc", "upper", "lower", "ref"]
    kept = written(parts.where("part = 'main'").select(copy_key("net", "copy").alias("net"), *names), "kept")
    off = written(parts.where("part = 'orphan'").select(copy_key("net", "copy", "orphan_id").alias("net"), *names), "off")
    main_nodes, main_edges = features.build_graph(kept)
    o_nodes, o_edges = features.build_graph(off)
    links = simulate.orphans(cut)
    named = lambda n: [c.alias(a) for c, a in zip(copy_parts(F.col("net"), n), ("net", "copy", "orphan_id"))]
    o_levels, m_levels = o_nodes.select(*named(2), "level", "idx"), main_nodes.select(*named(1), "level", "idx")
    pairs = simulate.negative_pairs(links, o_levels.drop("idx"), m_levels.drop("idx"), n_neg=n_neg, seed=seed)
    pairs = pairs.join(o_levels.select("net", "copy", "orphan_id", F.col("level").alias("orphan_level"), F.col("idx").alias("po")), ["net", "copy", "orphan_id", "orphan_level"])
    pairs = pairs.join(m_levels.select("net", "copy", F.col("level").alias("main_level"), F.col("idx").alias("pm")), ["net", "copy", "main_level"])
    of_orphan = pairs.groupBy("net", "copy", "orphan_id").agg(F.collect_list(F.struct("k", "po", "pm", "label")).alias("pairs"))
    graph = model.graphs(o_nodes, o_edges).select(*named(2), "sample")
    rows = graph.join(of_orphan, ["net", "copy", "orphan_id"]).select(copy_key("net", "copy").alias("net"), "orphan_id", F.col("sample").alias("graph"), "pairs")

    def merge(g, rows):
        out = []
        for r in sorted(rows if rows is not None else [], key=lambda r: r["orphan_id"]):
            o = {k: v for k, v in model.unpacked(bytes(r["graph"])).items() if k in ("x", "ends", "attr")}
            p = sorted(r["pairs"], key=lambda q: (q["k"], q["po"], q["pm"]))
            out.append(o | {"pair_o": np.array([q["po"] for q in p]), "pair_m": np.array([q["pm"] for q in p]), "label": np.array([q["label"] for q in p], dtype=float)})
        return g | {"orphans": out}

    return _joined(model.graphs(main_nodes, main_edges).join(rows.select("net").distinct(), "net", "left_semi"), _rows(rows, "orphan_id", "graph", "pairs"), merge)


def linked_sizes(batches):
    """(net, main_levels, orphans, orphan_levels, pairs, true_pairs) of batches of linked samples, for ``mapInPandas``."""
    for b in batches:
        rows = []
        for net, raw in zip(b["net"], b["sample"]):
            g = model.unpacked(bytes(raw))
            o = g["orphans"]
            rows.append((net, len(g["x"]), len(o), sum(len(x["x"]) for x in o), sum(len(x["label"]) for x in o), int(sum(x["label"].sum() for x in o))))
        yield pd.DataFrame(rows, columns=["net", "main_levels", "orphans", "orphan_levels", "pairs", "true_pairs"])


def train_model(transitions: DataFrame, validation: DataFrame, *, epochs: int = 1000, n_refits: int = 200, n_graphs: int = 30, seed: int = 0, rate: float = 1e-3, check_every: int = 50, log=None) -> model.Params:
    """All four heads on refit, corrupted and linked samples of the training nets; the least loss on ``validation`` is kept.

    An epoch takes all refit samples and draws as many of the others as ``model.PER_EPOCH`` says.
    """
    kinds = {"refit": refit_samples(transitions, n_samples=n_refits, seed=seed), "corrupted": corrupted_samples(transitions, n_graphs=n_graphs, seed=seed), "linked": linked_samples(transitions, n_graphs=n_graphs, seed=seed)}
    samples = reduce(DataFrame.unionByName, [s.withColumn("kind", F.lit(k)) for k, s in kinds.items()])
    held = written(refit_samples(validation, n_samples=n_refits, seed=seed + 1), "validation")
    return model.train(written(samples, "train"), held, epochs=epochs, per_epoch=model.PER_EPOCH, check_every=check_every, rate=rate, seed=seed, log=log)


def outlier_evaluation(transitions: DataFrame, p: model.Params, *, n_graphs: int = 30, seed: int = 1) -> dict[str, DataFrame]:
    """Detection metrics of the outlier head on corrupted copies: ``ap_by_net`` and its mean ``ap``, the others over all copies."""
    bad = written(simulate.main_of_copies(simulate.corrupt(simulate.copies(main_components(transitions), n_graphs), seed=seed)), "bad")
    nodes, edges = features.build_graph(bad.drop("copy"))
    scored = written(model.score_lines(nodes, edges, p).join(bad, ["net", "seq"]).withColumnRenamed("logit", "score"), "scored")
    by_net = metrics.average_precision(scored.withColumn("of", copy_parts(F.col("net"), 1)[0]), F.col("kind") > 0, "of").withColumnRenamed("of", "net")
    return {
        "ap_by_net": by_net, "ap": metrics.mean_over(by_net, "ap"), "detection": metrics.detection(scored), "p_at_k": metrics.precision_at_k(scored, "net"),
        "by_kind": metrics.by_kind(scored), "by_magnitude": metrics.by_magnitude(scored),
    }


def calibration(transitions: DataFrame, p: model.Params, *, n_samples: int = 100, seed: int = 2) -> DataFrame:
    """(source, nll, coverage): the model's widths and path uncertainties against refit errors."""
    main = written(main_components(transitions), "main")
    energies = written(solve.solve_energies(main), "energies")
    err = written(simulate.without_ground(simulate.refit_errors(main, energies, n_samples=n_samples, seed=seed), energies), "errors")
    nodes, edges = features.build_graph(main, energies)
    learned = model.score_levels(nodes, edges, p).select("net", "level", F.exp("log_sigma").alias("sigma"))
    paths = solve.path_uncertainty(main, energies).where("sp_unc > 0").select("net", "level", (F.col("sp_unc") * 1e6).alias("sigma"))
    named = lambda s, d: metrics.gaussian_nll(err, d).select(F.lit(s).alias("source"), "nll", "coverage")
    return named("model", learned).unionByName(named("path", paths))


def advise_corrections(transitions: DataFrame, p: model.Params, *, j_pos: int = 1) -> DataFrame:
    """Corrections to look at: flagged lines with their best candidate.  Never fed back."""
    energies = written(solve.solve_energies(transitions), "energies")
    nodes, edges = features.build_graph(transitions, energies)
    scored = written(transitions.join(model.score_lines(nodes, edges, p), ["net", "seq"]), "scored")
    cand = candidates.correction_candidates(scored.where("logit > 0"), energies, j_pos=j_pos)
    number = energies.select("net", "level", "idx")
    cand = cand.join(scored.select("net", "seq", "lower"), ["net", "seq"]).join(number.select("net", F.col("level").alias("cand_level"), F.col("idx").alias("cand")), ["net", "cand_level"])
    cand = cand.join(number.select("net", F.col("level").alias("lower"), F.col("idx").alias("low")), ["net", "lower"])
    attr = edges.where("dir = 0").select("net", "seq", "attr")
    h = written(model.score_levels(nodes, edges, p).select("net", "idx", "h"), "embeddings")
    rows = cand.join(attr, ["net", "seq"]).join(h.select("net", F.col("idx").alias("cand"), F.col("h").alias("h_c")), ["net", "cand"]).join(h.select("net", F.col("idx").alias("low"), F.col("h").alias("h_l")), ["net", "low"])

    def run(batches):
        w = model.leaves(p)
        for b in batches:
            if len(b):
                z = np.concatenate([np.stack(b["h_c"].to_list()), np.stack(b["h_l"].to_list()), np.stack(b["attr"].to_list()), b[["dj_upper", "dj_lower", "mismatch"]].to_numpy()], axis=1)
                yield b[["net", "seq", "pos", "cand_level"]].assign(logit=model.head(w, "fix", model.Value(z)).data)

    logits = rows.select("net", "seq", "pos", "cand_level", "h_c", "h_l", "attr", "dj_upper", "dj_lower", "mismatch").mapInPandas(run, "net string, seq long, pos int, cand_level string, logit double")
    return candidates.correction_report(scored, "logit", logits)


def advise_links(main: DataFrame, orphans: DataFrame, p: model.Params, *, k: int = candidates.TOP) -> DataFrame:
    """Links of orphan components to look at: ``orphans`` are lines with ``orphan``; the best pairs of each.  Never fed back."""
    nodes, edges = features.build_graph(main)
    off = orphans.withColumn("net", copy_key("net", "orphan"))
    o_nodes, o_edges = features.build_graph(off.drop("orphan"))
    # a level's vector is its quantum numbers and its embedding
    vector = lambda n, e: n.join(model.score_levels(n, e, p).select("net", "level", "h"), ["net", "level"]).withColumn("v", F.concat(F.slice("x", 1, model.QN_SLOTS), "h"))
    of_main = vector(nodes, edges).select("net", "level", "v")
    name, orphan = copy_parts(F.col("net"), 1)
    of_orphan = vector(o_nodes, o_edges).select(name.alias("net"), orphan.alias("orphan"), "level", "v")

    def score(o: np.ndarray, m: np.ndarray) -> np.ndarray:
        w, n = model.leaves(p), model.QN_SLOTS
        a = np.broadcast_to(o[n:], m[:, n:].shape)
        return model.link_logits(w, model.Value(a), model.Value(m[:, n:]), np.broadcast_to(o[:n], m[:, :n].shape), m[:, :n]).data

    best = candidates.best_pairs(of_orphan, of_main, score, k=k)
    return candidates.orphan_report(best.withColumnRenamed("score", "logit").drop("rank"), "logit", k=k)


def link_ranks(samples: DataFrame, p: model.Params) -> DataFrame:
    """(net, orphan, rank, n): place of each orphan's true link among all pairs of its levels and the main ones.

    Pairs are scored one orphan level at a time and counted, never held together.
    """

    def run(batches):
        w = model.leaves(p)
        for b in batches:
            out = []
            for net, raw in zip(b["net"], b["sample"]):
                g = model.unpacked(raw)
                h, q = model.encode(w, g["x"], g["ends"], g["attr"]), g["x"][:, : model.QN_SLOTS]
                every = np.arange(len(q))
                for k, o in enumerate(g.get("orphans", ())):
                    ho, qo = model.encode(w, o["x"], o["ends"], o["attr"]), o["x"][:, : model.QN_SLOTS]
                    row = lambda i: model.link_logits(w, ho.take(np.full(len(every), i)), h, qo[np.full(len(every), i)], q).data  # noqa: E731, B023
                    at = int(np.flatnonzero(o["label"])[0])
                    true = row(int(o["pair_o"][at]))[int(o["pair_m"][at])]
                    above = sum(int((row(i) > true).sum()) for i in range(len(qo)))
                    out.append((net, k, above + 1, len(qo) * len(q)))
            yield pd.DataFrame(out, columns=["net", "orphan", "rank", "n"])

    return samples.select("net", "sample").mapInPandas(run, "net string, orphan int, rank long, n long")


def fix_ranks(samples: DataFrame, p: model.Params) -> DataFrame:
    """(net, suspect, rank, n): place of the true upper level in each suspect line's window."""

    def run(batches):
        w = model.leaves(p)
        for b in batches:
            out = []
            for net, raw in zip(b["net"], b["sample"]):
                g = model.unpacked(raw)
                if not len(g.get("cand", ())):
                    continue
                logit = model.fix_logits(w, model.encode(w, g["x"], g["ends"], g["attr"]), g["cand"], g["lower"], g["line_attr"], g["extras"]).data
                for s in np.unique(g["suspect"]):
                    mine = g["suspect"] == s
                    true = logit[mine][g["target"][mine] == 1][0]
                    out.append((net, int(s), int((logit[mine] > true).sum()) + 1, int(mine.sum())))
            yield pd.DataFrame(out, columns=["net", "suspect", "rank", "n"])

    return samples.select("net", "sample").mapInPandas(run, "net string, suspect long, rank long, n long")


def evaluation(transitions: DataFrame, p: model.Params, *, n_graphs: int = 30, seed: int = 5, published: DataFrame | None = None) -> dict[str, DataFrame]:
    """Metrics of all heads on the main components of validation nets; with ``published`` levels, how many lie within path uncertainties."""
    corrupted = written(corrupted_samples(transitions, n_graphs=n_graphs, seed=seed), "corrupted")
    linked = written(linked_samples(transitions, n_graphs=n_graphs, seed=seed), "linked")
    return {
        "calibration": calibration(transitions, p, seed=seed), **outlier_evaluation(transitions, p, n_graphs=n_graphs, seed=seed),
        "fix": metrics.fix_metrics(fix_ranks(corrupted, p)), "link": metrics.link_metrics(link_ranks(linked, p)),
        **({"sanity": metrics.within_sigma(solve.solve_network(main_components(transitions)), published)} if published is not None else {}),
    }
