"""Components, energies, uncertainties, features."""

import math

import pytest
from pyspark.errors import PySparkException

from lineweave.operators import features, network, solve


def energies(df):
    return {r.level: r.energy for r in solve.solve_energies(df).collect()}


def test_components_and_routing(net):
    t = net([(1, 1e-3, "a", "b"), (1, 1e-3, "x", "y"), (1, 1e-3, "b", "c"), (0, 1e-3, "z", "z")])
    for method in ("by_net", "distributed"):
        got = {r.level: (r.comp, r.n_levels, r.idx) for r in network.components(t, method=method).collect()}
        assert got == {"a": (1, 3, 0), "b": (1, 3, 1), "c": (1, 3, 4), "x": (2, 2, 2), "y": (2, 2, 3), "z": (3, 1, 5)}
    solvable, dropped = network.split_components(t, minsize=3)
    assert solvable.count() == 2 and dropped.count() == 2
    assert sorted(r.seq for r in network.largest_component(t).collect()) == [0, 2]
    assert not network.is_connected(t).first().connected


def test_star_components_on_a_long_path(spark):
    e = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert network.star_components(e).selectExpr("min(root)", "max(root)", "count(*)").first() == (0, 0, 300)


def test_solves(net):
    assert energies(net([(10, 1e-3, "b", "a"), (5, 1e-3, "c", "b")])) == {"a": 0.0, "b": 10.0, "c": 15.0}
    doubled = energies(net([(10.0, 1e-3, "b", "a"), (10.4, 2e-3, "b", "a")]))
    assert doubled["b"] == pytest.approx((10.0 / 1e-6 + 10.4 / 4e-6) / (1 / 1e-6 + 1 / 4e-6))
    tri = energies(net([(10, 1e-3, "b", "a"), (5, 1e-3, "c", "b"), (15, 1e-3, "c", "a")]))
    assert tri["c"] == pytest.approx(15, abs=1e-12)
    t = net([(10.0, 1e-3, "b", "a"), (10.4, 1e-3, "b", "a")])
    assert energies(t)["b"] == pytest.approx(10.2)
    other = t.selectExpr("*", "CASE seq WHEN 0 THEN 1e-3 ELSE 2e-3 END AS u2")
    assert {r.level: r.energy for r in solve.solve_energies(other, unc="u2").collect()}["b"] == pytest.approx(10.08)
    with pytest.raises(PySparkException, match="uncertainty is zero"):
        energies(net([(10.0, 0.0, "b", "a")]))


def paths(t):
    return {r.level: r.sp_unc for r in solve.path_uncertainty(t, solve.solve_energies(t)).collect()}


def test_path_uncertainties(net):
    got = paths(net([(10, 1e-3, "b", "a"), (5, 2e-3, "c", "b")]))
    assert got["a"] == 0 and got["b"] == pytest.approx(1e-3) and got["c"] == pytest.approx(math.sqrt(5e-6))
    assert paths(net([(10, 5e-3, "b", "a"), (10, 1e-3, "b", "a")]))["b"] == pytest.approx(1e-3)


def test_bootstrap_and_combination(net, spark):
    tree = net([(10, 1e-3, "b", "a"), (5, 2e-3, "c", "b")])
    e = solve.solve_energies(tree)
    boot = solve.bootstrap_statistics(solve.bootstrap_samples(tree, iterations=10), e)
    assert max(r.boot_unc for r in boot.collect()) < 1e-9
    conflict = net([(10.0, 1e-3, "b", "a"), (10.4, 1e-3, "b", "a")])
    e2 = solve.solve_energies(conflict)
    assert {r.level: r.boot_unc for r in solve.bootstrap_statistics(solve.bootstrap_samples(conflict, iterations=40), e2).collect()}["b"] > 0.01
    costs = spark.createDataFrame([("n", "a", 0.0, 0.0), ("n", "b", 1e-3, 3e-3), ("n", "c", 2e-3, 1e-3)], "net string, level string, sp_unc double, boot_unc double")
    got = {r.level: r.unc for r in solve.combined_uncertainty(tree, e, costs).collect()}
    assert got["a"] == 0 and got["b"] == pytest.approx(3e-3) and got["c"] == pytest.approx(math.sqrt(13e-6))
    whole = {r.level: r.unc for r in solve.solve_network(tree, bootstrap_iterations=5).collect()}
    assert whole["c"] == pytest.approx(math.sqrt(6e-6))
    # one sample has no deviation
    one = solve.bootstrap_statistics(spark.createDataFrame([("n", "a", 1.0)], "net string, level string, energy double"), spark.createDataFrame([("n", "a", 3.0)], "net string, level string, energy double"))
    assert one.first().boot_unc == pytest.approx(2 * math.sqrt(2))
    with pytest.raises(PySparkException, match="original uncertainty is zero"):
        solve.bootstrap_samples(tree.selectExpr("net", "seq", "freq", "unc", "0.0D AS orig_unc", "upper", "lower", "ref"), iterations=1).collect()


def test_leverages_of_a_ladder(net, ladder):
    h = {r.seq: r for r in features.leverages(net(ladder(10))).collect()}
    assert sum(r.leverage for r in h.values()) == pytest.approx(9)
    assert all(h[i].leverage == 1 and h[i].bridge for i in range(2, 9))
    assert all(h[i].leverage == pytest.approx(2 / 3) for i in (0, 1, 9))
    double = features.leverages(net([(1, 1e-3, "a", "b"), (1, 1e-3, "a", "b")])).collect()
    assert all(r.bridge and r.leverage == pytest.approx(0.5) for r in double)


def test_graph_of_a_ladder(net, ladder):
    nodes, edges = features.build_graph(net(ladder(10)))
    n = {r.level: r.x for r in nodes.collect()}
    assert len(n) == 10 and all(len(x) == features.NODE_DIM for x in n.values())
    assert n["0 2"][8] == pytest.approx(math.log1p(3)) and n["0 2"][9] == pytest.approx(-0.3) and n["0 0"][12] == 0
    assert n["0 3"][1] == pytest.approx(3 / 50) and n["0 3"][7] == pytest.approx(2 / 7)
    e = edges.collect()
    assert len(e) == 20 and all(len(r.attr) == features.EDGE_DIM for r in e)
    shifted = features.build_graph(net([(-2.0, 1e-3, "0 1", "0 0"), (1.0, 1e-3, "0 2", "0 0")]))[1]
    assert {r.seq: r.attr[1] is None for r in shifted.collect()} == {0: True, 1: False}


def test_empty_input(net):
    t = net([])
    assert network.components(t).count() == 0 and solve.solve_energies(t).count() == 0 and network.level_index(t).count() == 0


def test_laplacian_of_turned_parallel_and_looped_lines(net):
    from lineweave.operators import solve

    t = net([(1.0, 0.5, "1 0", "0 0"), (1.0, 1.0, "0 0", "1 0"), (1.0, 1.0, "1 0", "0 1"), (1.0, 0.1, "0 1", "0 1"), (1.0, 0.1, "2 0", "2 0")])
    got = {(r.i, r.j): r.val for r in solve.laplacian(t).collect()}
    want = {("1 0", "1 0"): 6.0, ("0 0", "0 0"): 5.0, ("0 1", "0 1"): 1.0, ("2 0", "2 0"): 0.0, ("1 0", "0 0"): -5.0, ("0 0", "1 0"): -5.0, ("1 0", "0 1"): -1.0, ("0 1", "1 0"): -1.0}
    assert got == pytest.approx(want)
