"""The encoder and its heads against loops over levels and lines; draws of an epoch; losses at large gaps."""

import numpy as np
import pytest

from lineweave.operators import features, model, solve
from lineweave.plans import training


def slow_encode(p, x, ends, attr):
    """Attention level by level: its lines and itself, whose features are the mean of the lines that end there."""
    leaky = lambda v, k: np.where(v > 0, v, k * v)
    h, k = x, 0
    while f"conv{k}.src" in p:
        out = []
        for v in range(len(h)):
            mine = [i for i in range(ends.shape[1]) if ends[1, i] == v]
            own = np.mean([attr[i] for i in mine], axis=0) if mine else np.zeros(attr.shape[1])
            from_, feature = [ends[0, i] for i in mine] + [v], [attr[i] for i in mine] + [own]
            right = h[v] @ p[f"conv{k}.dst"] + p[f"conv{k}.dst_b"]
            left = [h[a] @ p[f"conv{k}.src"] + p[f"conv{k}.src_b"] for a in from_]
            logit = np.array([(leaky(m + right + e @ p[f"conv{k}.edge"], model.SLOPE) @ p[f"conv{k}.att"])[0] for m, e in zip(left, feature)])
            share = np.exp(logit - logit.max())
            share /= share.sum()
            z = sum(s * m for s, m in zip(share, left)) + p[f"conv{k}.bias"]
            z = (z - z.mean()) / np.sqrt(z.var() + 1e-5) * p[f"norm{k}.scale"] + p[f"norm{k}.shift"]
            out.append(np.maximum(z, 0))
        h, k = np.stack(out), k + 1
    return h


def slow_head(p, name, z):
    return float((np.maximum(z @ p[f"{name}.w1"] + p[f"{name}.b1"], 0) @ p[f"{name}.w2"] + p[f"{name}.b2"])[0])


@pytest.fixture
def some(net, ladder, spark):
    rng = np.random.default_rng(3)
    lines = ladder(9) + [(21.3, 2e-3, "0 2", "0 0"), (33.4, 1e-3, "0 5", "0 3")]
    t = net(lines)
    nodes, edges = features.build_graph(t)
    p = {k: v + rng.normal(0, 0.1, v.shape) for k, v in model.initial(5, hidden=6, layers=2).items()}
    x, ends, attr = features.as_arrays(nodes.toPandas(), edges.toPandas())
    return t, nodes, edges, p, x, ends, attr


def test_widths_and_outlier_logits_equal_loops(some):
    t, nodes, edges, p, x, ends, attr = some
    h = slow_encode(p, x, ends, attr)
    got = {r.idx: r for r in model.score_levels(nodes, edges, p).collect()}
    for i in range(len(x)):
        assert np.allclose(got[i].h, h[i]) and got[i].log_sigma == pytest.approx(slow_head(p, "unc", h[i]))
    rows = sorted(t.collect(), key=lambda r: r.seq)
    at = {r.level: r.idx for r in nodes.collect()}
    logit = {r.seq: r.logit for r in model.score_lines(nodes, edges, p).collect()}
    for k, r in enumerate(rows):
        assert logit[r.seq] == pytest.approx(slow_head(p, "outlier", np.concatenate([h[at[r.upper]], h[at[r.lower]], attr[2 * k]])))


def test_link_and_fix_logits_equal_loops(some):
    _, _, _, p, x, ends, attr = some
    h, w = slow_encode(p, x, ends, attr), model.leaves(p)
    n = model.QN_SLOTS
    a, b = np.array([0, 3, 5]), np.array([2, 3, 1])
    got = model.link_logits(w, model.Value(h[a]), model.Value(h[b]), x[a, :n], x[b, :n]).data
    assert got == pytest.approx([slow_head(p, "link", np.concatenate([h[i] + h[j], abs(h[i] - h[j]), abs(x[i, :n] - x[j, :n])])) for i, j in zip(a, b)])
    extras = np.array([[0.1, 0.2, 0.3], [0.0, 0.5, 1.0], [0.4, 0.4, 0.1]])
    got = model.fix_logits(w, model.Value(h), a, b, attr[:3], extras).data
    assert got == pytest.approx([slow_head(p, "fix", np.concatenate([h[i], h[j], attr[k], extras[k]])) for k, (i, j) in enumerate(zip(a, b))])


def test_cross_entropy_at_large_gaps():
    z = model.Value(np.array([800.0, -800.0, 3.0, 1.0]))
    loss = model.cross_entropy(z, np.array([0, 0, 1, 1]), np.array([0, 1, 1, 0]))
    loss.backward()
    assert loss.data == pytest.approx((1600 + np.log(1 + np.exp(-2.0))) / 2) and np.isfinite(z.grad).all()
    assert z.grad == pytest.approx([0.5, -0.5, -0.5 / (1 + np.exp(2.0)), 0.5 / (1 + np.exp(2.0))])


def test_epochs_draw_by_kind(spark):
    rows = [(k, i, f"{k}{i}") for k, n in (("refit", 3), ("corrupted", 20), ("linked", 9)) for i in range(n)]
    samples = spark.createDataFrame(rows, "kind string, nth int, net string")
    counts = {"refit": 3, "corrupted": 20, "linked": 9}
    seen = []
    for epoch in range(3):
        got = [tuple(r) for r in model.epoch_samples(samples, counts, model.PER_EPOCH, 1, epoch).select("kind", "nth").collect()]
        assert len(got) == len(set(got)) == 3 + 6 + 4 and {k for k, _ in got} == set(counts)
        seen.append(frozenset(got))
    assert len(set(seen)) == 3
    with pytest.raises(ValueError):
        model.mean_gradient(spark.createDataFrame([], "sample binary"), model.initial(0, hidden=2, layers=1))


def test_nets_of_any_name_in_linked_samples(net, spark):
    ring = [(1.0 + i, 1e-3, f"0 {(i + 1) % 6}", f"0 {i}") for i in range(5)] + [(15.0, 1e-3, "0 5", "0 0")]
    tail = [(2.0, 1e-3, f"1 {i + 1}", f"1 {i}") for i in range(3)] + [(4.0, 1e-3, "1 0", "0 3")]
    t = net(ring + tail, "a#1#2")
    got = training.linked_samples(t, n_graphs=2, n_neg=3).collect()
    assert {r.net for r in got} <= {"a#1#2#0", "a#1#2#1"} and got
    assert all(model.unpacked(bytes(r.sample))["orphans"] for r in got)
    ranks = training.link_ranks(training.linked_samples(t, n_graphs=2, n_neg=3), model.initial(1, hidden=4, layers=1)).collect()
    assert all(1 <= r["rank"] <= r["n"] for r in ranks)


def test_bootstrap_of_conflicting_lines(net):
    """Two parallel lines: each sample is their mean by the weights it drew."""
    t = net([(10.0, 1e-3, "a", "b"), (10.4, 2e-3, "a", "b")])
    drawn = {}
    for r in solve.resampled(t, iterations=6, seed=4).collect():
        drawn.setdefault(r["sample"], []).append((r.freq, r.drawn))
    want = {s: sum(f / u**2 for f, u in v) / sum(1 / u**2 for _, u in v) for s, v in drawn.items()}
    got = {r["sample"]: r.energy for r in solve.bootstrap_samples(t, iterations=6, seed=4).where("level = 'a'").collect()}
    assert got == pytest.approx(want) and len(set(round(v, 9) for v in got.values())) > 1


def test_embeddings_row_by_row_equal_those_of_whole_networks(monkeypatch):
    """No intermediate value of scores has more rows than ``ROWS`` levels and the lines that end there."""
    rng = np.random.default_rng(5)
    n, m = 60, 150
    x, attr, ends = rng.normal(size=(n, model.NODE_DIM)), rng.normal(size=(m, model.EDGE_DIM)), rng.integers(0, n, (2, m))
    w, most, whole = model.leaves(model.initial(3, hidden=8)), [], model._attended
    want = model.encode(w, x, ends, attr)
    monkeypatch.setattr(model, "ROWS", 7)
    monkeypatch.setattr(model, "_attended", lambda *a: most.append(a[-1]) or whole(*a))
    h = model.embedded(w, x, ends, attr)
    assert np.allclose(h, want.data, atol=1e-12) and max(most) == 7
    assert np.allclose(model.by_rows(lambda at: model.log_sigma(w, model.Value(h[at])), n), model.log_sigma(w, want).data, atol=1e-12)
