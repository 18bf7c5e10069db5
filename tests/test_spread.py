"""Networks beyond one task: elimination in rounds and delta-stepping against the kernels and against plain loops."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.operators import dissection, features, network, paths, solve


def grid(n, seed=0):
    """A grid of n by n levels with noise, a tail, a hub with leaves, parallel lines and a second component."""
    r = random.Random(seed)
    at = {(i, j): 100.0 * i + 3.0 * j for i in range(n) for j in range(n)}
    rows = []
    for (i, j), e in at.items():
        for k in ((i + 1, j), (i, j + 1)):
            if k in at:
                rows.append((at[k] - e + r.gauss(0, 0.01), 10 ** r.uniform(-4, 0), f"{k[0]} {k[1]}", f"{i} {j}"))
    rows += [(1.0 + k, 0.1, f"t {k + 1}", f"t {k}") for k in range(9)] + [(5.0, 0.1, "t 0", "0 0")]
    rows += [(7.0 + k / 10, 0.2, f"h {k}", "2 2") for k in range(20)]
    rows += [(9.0, 0.1, "0 1", "0 0"), (2.5, 1.0, "z 1", "z 0"), (2.7, 0.5, "z 1", "z 0"), (3.0, 0.1, "s", "s2")]
    r.shuffle(rows)
    return rows


def found(df):
    return sorted((r["net"], r["comp"], r["idx"], r["level"], r["energy"]) for r in df.collect())


def test_spread_solve_equals_kernel(spark, net):
    t = net(grid(5), "a").unionByName(net([(1.0, 0.1, "p", "q")], "b"))
    got, want = found(dissection.solve_spread(t, most=12)), found(solve.solve_energies(t))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=0, atol=1e-7)


def test_clusters_are_bounded(spark, net):
    t = net(grid(10))
    ids = dissection.level_ids(t)
    named = lambda e, to: ids.select("net", F.col("level").alias(e), F.col("id").alias(to))
    lines = t.join(named("upper", "a"), ["net", "upper"]).join(named("lower", "b"), ["net", "lower"]).select("net", F.lit(0).cast("long").alias("root"), "a", "b", F.lit(1.0).alias("w"), F.col("freq").alias("d"))
    of = dissection.clusters(lines, 20, 0)
    assert of.count() == ids.count() == of.select("net", "v").distinct().count()
    assert of.groupBy("net", "c", "s").count().agg(F.max("count")).first()[0] <= 60  # parts of a split are dealt by hash


def test_fill_that_no_cluster_can_take(spark, net):
    r = random.Random(1)
    full = [(float(i - j), 0.1, f"x {i}", f"x {j}") for i in range(70) for j in range(i) if r.random() < 0.9]
    assert np.allclose([g[4] for g in found(dissection.solve_spread(net(full), most=20))], [w[4] for w in found(solve.solve_energies(net(full)))], atol=1e-9)
    with pytest.raises(ValueError, match="can't take out"):
        dissection.solve_spread(net(full), most=20, force=False)


def test_spread_solve_edges(spark, net):
    assert found(solve.solve_energies(net([]), method="distributed")) == []
    one = net([(1.0, 0.1, "a", "a"), (2.0, 0.1, "b", "c")])
    assert found(solve.solve_energies(one, method="distributed")) == found(solve.solve_energies(one))
    with pytest.raises(Exception, match="uncertainty is zero"):
        solve.solve_energies(net([(1.0, 0.0, "a", "b")]), method="distributed").collect()
    with pytest.raises(ValueError):
        solve.solve_energies(one, method="other")


def test_star_elimination_of_one_cluster():
    """Taking out levels of a path leaves one line of summed steps and resistances."""
    a, b, w, d = np.arange(5), np.arange(1, 6), np.array([1.0, 2.0, 4.0, 5.0, 10.0]), -np.arange(1.0, 6.0)
    may = np.array([False, True, True, True, True, False])
    (la, lb, lw, ld), stars = dissection.take_out(6, a, b, w, d, may)
    assert (la.tolist(), lb.tolist()) == ([0], [5]) and sum(len(v) for v, *_ in stars) == 4 and all(np.allclose(share.sum(axis=1), 1) for _, _, share, _, _ in stars)
    assert lw[0] == pytest.approx(1 / (1 / w).sum()) and ld[0] == pytest.approx(d.sum())


def slow_costs(edges, roots):
    out = {r: 0.0 for r in roots}
    heap = [(0.0, r) for r in roots]
    near = {}
    for s, t, c in edges:
        near.setdefault(s, []).append((t, c))
    while heap:
        d, a = heapq.heappop(heap)
        if d > out[a]:
            continue
        for b, c in near.get(a, ()):
            if d + c < out.get(b, float("inf")):
                out[b] = d + c
                heapq.heappush(heap, (d + c, b))
    return out


@pytest.mark.parametrize("factor", [0.2, 4.0])
def test_least_costs_equal_loops(spark, factor):
    r = random.Random(7)
    edges = {n: [(f"v{r.randrange(20)}", f"v{r.randrange(20)}", r.choice([0.0, r.random(), 10 * r.random()])) for _ in range(70)] for n in ("a", "b")}
    df = spark.createDataFrame([(n, *e) for n, es in edges.items() for e in es], "net string, src string, dst string, cost double")
    roots = spark.createDataFrame([("a", "v1"), ("b", "v2"), ("b", "v3"), ("b", "v3"), ("b", "far")], "net string, level string")
    got, rounds = paths.least_costs(df, roots, paths.widths(df, factor))
    assert rounds > 2
    want = {("a", k): v for k, v in slow_costs(edges["a"], ["v1"]).items()} | {("b", k): v for k, v in slow_costs(edges["b"], ["v2", "v3", "far"]).items()}
    assert {(x["net"], x["level"]): pytest.approx(x["dist"], abs=1e-12) for x in got.collect()} == want


def test_spread_uncertainties_equal_kernel(spark, net):
    t = net(grid(4, 3), "a").unionByName(net(grid(3, 4), "b"))
    e = solve.solve_energies(t)
    sp = lambda m: {(r["net"], r["comp"], r["level"]): r["sp_unc"] for r in solve.path_uncertainty(t, e, method=m).collect()}
    a, b = sp("by_net"), sp("distributed")
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    costs = e.select("net", "level", (F.pmod(F.xxhash64("level"), F.lit(9)) / 10 + 0.1).alias("sp_unc"), F.lit(0.3).alias("boot_unc")).where("level <> '1 1'")
    both = lambda m: {(r["net"], r["level"]): r["unc"] for r in solve.combined_uncertainty(t, e, costs, method=m).collect()}
    a, b = both("by_net"), both("distributed")
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_spread_bridges_equal_kernel(spark, net):
    r = random.Random(3)
    rows = grid(3, 1) + [(1.0, 0.1, f"r {i}", f"r {r.randrange(max(0, i - 3), i)}") for i in range(1, 30)] + [(1.0, 0.1, "r 20", "r 11"), (1.0, 0.1, "r 5", "r 2"), (2.0, 0.1, "loop", "loop")]
    t = net(rows, "a").unionByName(net([(1.0, 0.1, "p", "q"), (2.0, 0.1, "q", "p")], "b"))
    pairs = lambda df: sorted(map(tuple, df.select("net", "a", "b").collect()))
    got = pairs(network.bridges(t, method="distributed"))
    assert got == pairs(network.bridges(t)) and ("b", "p", "q") in got and len(got) > 10
    assert pairs(network.bridges(net([]), method="distributed")) == pairs(network.bridges(net([]))) == []
    with pytest.raises(ValueError):
        network.bridges(t, method="other")


def test_spread_leverages_equal_kernel(spark, net):
    t = net(grid(5) + [(1.0, 0.1, "loop", "loop")], "a").unionByName(net([(1.0, 0.1, "p", "q"), (2.0, 0.2, "q", "p")], "b"))
    of = lambda df: {(r["net"], r["seq"]): (r["leverage"], r["bridge"]) for r in df.collect()}
    got, want = of(features.leverages(t, method="distributed", most=12)), of(features.leverages(t))
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=1e-9), want[k][1]) for k in got)


def test_bridges_leave_few_links_for_the_forest(spark, net, monkeypatch):
    """Chains, rings, doubled lines and random links: bridges as by kernels, and the forest grows only over what can't be peeled."""
    from lineweave.operators import forest

    rng = np.random.default_rng(4)
    t = None
    for k, n in enumerate((2, 3, 30, 60, 60)):
        m = n if k < 4 else 3 * n  # sparse nets with trees and chains of rings; a dense one
        rows = [(1.0, 1.0, f"1 {i}", f"1 {j}") for i, j in rng.integers(0, n, (m, 2)) if i != j] + [(1.0, 1.0, f"2 {i + 1}", f"2 {i}") for i in range(n)]
        one = net(rows + [(1.0, 1.0, "2 0", "1 0"), (1.0, 1.0, "3 0", "3 1"), (1.0, 1.0, "3 1", "3 2"), (1.0, 1.0, "3 2", "3 0"), (1.0, 1.0, "3 0", "4 0")], f"n{k}")
        t = one if t is None else t.unionByName(one)
    grown = []
    whole = forest.uncrossed
    monkeypatch.setattr(forest, "uncrossed", lambda links: grown.append(links.count()) or whole(links))
    found = sorted(map(tuple, network.bridges(t, method="distributed").select("net", "a", "b").collect()))
    assert found == sorted(map(tuple, network.bridges(t).select("net", "a", "b").collect()))
    assert 0 < grown[0] * 2 < network.simple_edges(t).count()


def test_star_rounds_keep_keys_apart(spark):
    """One number in two nets is two nodes, and rounds add up numbers, not structs of net and number."""
    e = spark.createDataFrame([("a", 3, 2), ("a", 2, 1), ("b", 3, 2), ("b", 9, 3)], "net string, a long, b long")
    assert sorted(map(tuple, network.star_components(e, "net").collect())) == [("a", 2, 1), ("a", 3, 1), ("b", 3, 2), ("b", 9, 2)]


def test_a_task_takes_many_clusters(spark, monkeypatch):
    """Clusters of few levels share a task, and what is left does not depend on how many do."""
    g = np.random.default_rng(5)
    a = np.arange(1, 300)
    b = np.where(g.random(299) < 0.8, a - 1, g.integers(0, a))
    lines = spark.createDataFrame([("n", 0, int(y), int(x), 1.0, float(x - y)) for x, y in zip(a, b)], "net string, root long, a long, b long, w double, d double")
    few = dissection.cluster_round(lines, 10, 0)
    clusters = dissection.clusters(lines, 10, 0).select("c", "s").distinct().count()
    assert clusters > 10 and few[0].select("lot").distinct().count() == 1
    monkeypatch.setattr(dissection, "LOT", 40)
    many = dissection.cluster_round(lines, 10, 0)
    assert many[0].select("lot").distinct().count() > 1
    rows = lambda df: sorted((r.a, r.b) for r in df.collect())
    gone = lambda df: {r.a for r in df.where("step >= 0").collect()}
    assert gone(few[0]) and all(abs(r.d - (r.b - r.a)) < 1e-9 or abs(r.d - (r.a - r.b)) < 1e-9 for r in few[1].collect())
    assert gone(few[0]) == gone(many[0]) and rows(few[1]) == rows(many[1])
