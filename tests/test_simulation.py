"""Corruption, masking, detachment, candidates, metrics, model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.operators import candidates, metrics, model, network, simulate, solve
from lineweave.plans import training


def test_corruption(net, ladder):
    t = net(ladder(40))
    c = simulate.corrupt(t, fraction=0.25, seed=3)
    rows = c.orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in simulate.corrupt(t.repartition(7), fraction=0.25, seed=3).orderBy("seq").collect()]
    bad = [r for r in rows if r.kind]
    assert len(bad) == 10 and {r.kind for r in bad} == {1, 2}
    for r in rows:
        j, k = (int(x.split()[1]) for x in (r.upper, r.orig_upper))
        if r.kind == simulate.QN_BUMP:
            assert abs(j - k) == 1 and j >= 0 and r.upper != r.lower and r.mag == 0
        elif r.kind == simulate.FREQ_SHIFT:
            assert 5 <= r.mag <= 500 and r.upper == r.orig_upper
        else:
            assert r.upper == r.orig_upper and r.mag == 0


def test_bump_without_a_target_becomes_a_shift(net):
    t = net([(1.0, 1e-3, "0 x", "0 0")]).selectExpr("net", "seq", "freq", "unc", "orig_unc", "'0 0' AS upper", "'0 1' AS lower", "ref")
    kinds = {simulate.corrupt(t, fraction=1.0, seed=s).first().kind for s in range(6)}
    assert kinds == {1}  # J = 0 may only go up, onto the lower level


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(n,) for n in (1, 10, 30, 50)], "n int")
    assert [r[0] for r in df.select(simulate.n_chosen(0.05, F.col("n"))).collect()] == [1, 1, 2, 2]


def test_labels_stay_with_the_main_component(net, ladder, spark):
    t = net(ladder(10)).unionByName(spark.createDataFrame([("n", 99, 1.0, 1e-3, 1e-3, "5 1", "5 0", "r.1")], net([]).schema)).withColumn("kind", F.lit(1))
    kept = network.largest_component(t)
    assert kept.count() == 10 and "kind" in kept.columns


def test_refits(net, ladder):
    t = net(ladder(10) + [(18.01, 1e-3, "0 9", "0 8")])
    e = solve.solve_energies(t)
    err = simulate.refit_errors(t, e, n_samples=40, seed=1, lost=True)
    again = simulate.refit_errors(t.repartition(3), e, n_samples=40, seed=1, lost=True)
    key = lambda r: (r.level, r["sample"])
    assert sorted(map(tuple, err.collect())) == sorted(map(tuple, again.collect())) if all(r.err is not None for r in err.collect()) else {key(r): r.err for r in err.collect()} == {key(r): r.err for r in again.collect()}
    assert err.count() == 400 and err.where("err is null").count() > 0
    sd = {r.level: r.s or 0 for r in err.groupBy("level").agg(F.stddev_pop("err").alias("s")).collect()}
    assert sd["0 9"] > 10 * max(sd["0 1"], 1e-9)


def test_refits_that_lose_the_ground(net):
    t = net([(1.0, 1e-3, "b", "a"), (2.0, 1e-3, "c", "b")])
    e = solve.solve_energies(t)
    found = simulate.refit_errors(t, e, n_samples=20, mask_fraction=0.5, seed=0)
    assert 0 < found.select("sample").distinct().count() < 20 and found.where("abs(err) > 1e-3").count() == 0


def test_detachment(net, spark):
    core = [(1.0, 1e-3, f"0 {(i + 1) % 6}", f"0 {i}") for i in range(6)]
    chains = [(1.0, 1e-3, "1 1", "0 2"), (1.0, 1e-3, "1 2", "1 1"), (1.0, 1e-3, "1 3", "1 2"), (1.0, 1e-3, "2 1", "0 4"), (1.0, 1e-3, "2 2", "2 1"), (1.0, 1e-3, "2 3", "2 2")]
    t = net(core + chains)
    e = solve.solve_energies(t)
    for seed in range(4):
        d = simulate.detached_levels(t, e, n_copies=2, seed=seed)
        parts = simulate.detached_parts(t, d, n_copies=2)
        assert parts.count() == 2 * t.count()
        found = d.groupBy("copy", "orphan_id").agg(F.count("*").alias("n")).collect()
        assert found and all(2 <= r.n <= 25 for r in found)
        main = parts.where("part = 'main' and copy = 0").drop("copy", "part", "orphan_id")
        assert network.is_connected(main).first().connected
        links = simulate.orphans(d).collect()
        assert links and all(o.orphan_level != o.main_level for o in links)
        levels = d.select("net", "copy", "orphan_id", "level")
        pairs = simulate.negative_pairs(simulate.orphans(d), levels, e.select("net", "level").crossJoin(spark.range(2).selectExpr("cast(id AS int) AS copy")), n_neg=7)
        assert pairs.groupBy("copy", "orphan_id").count().where("count <> 8").count() == 0


def test_candidates(net, ladder):
    t = net(ladder(12))
    e = solve.solve_energies(t)
    c = candidates.correction_candidates(t.withColumn("orig_upper", F.col("upper")), e).collect()
    assert c and all(r.cand_level != f"0 {r.seq}" for r in c if r.seq < 10)
    of5 = sorted((r.pos, r.cand_level) for r in c if r.seq == 5)  # 0 6 - 0 5: 0 5 is the lower level
    assert of5 == [(0, "0 4"), (2, "0 7"), (3, "0 8")]
    one = next(r for r in c if r.seq == 5 and r.pos == 2)
    assert one.dj_upper == pytest.approx(1 / 50) and one.dj_lower == pytest.approx(2 / 50) and one.mismatch == pytest.approx(math.log10(1 + 16.0 / 1e-3) / 4)
    assert candidates.recoverable(candidates.correction_candidates(t.withColumn("orig_upper", F.lit("9 9")), e)).count() == 0


def test_best_pairs_equal_all_pairs(spark):
    from lineweave.functions.scalars import qn_vector

    o = spark.createDataFrame([("n", 1, f"{a} {b}") for a in range(2) for b in range(3)] + [("n", 2, "9 9"), ("m", 1, "0 1")], "net string, orphan int, level string").withColumn("v", qn_vector(F.col("level")))
    m = spark.createDataFrame([("n", f"{a} {b}") for a in range(3) for b in range(4)], "net string, level string").withColumn("v", qn_vector(F.col("level")))
    slow = candidates.top_pairs(candidates.pair_features(o, m), -(F.col("dqn")[0] + F.col("dqn")[1]))
    fast = candidates.best_pairs(o, m, lambda x, y: -np.abs(y - x).sum(axis=1))
    key = lambda rs: sorted((r.net, r.orphan, r.orphan_level, r.main_level, r.score, r["rank"]) for r in rs)
    assert key(slow.collect()) == key(fast.collect()) and fast.count() == 10


def test_metrics(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 3, 60), np.round(rng.normal(size=60), 1)
    rows = spark.createDataFrame([("n", i, int(k), float(x), 7.0) for i, (k, x) in enumerate(zip(y, s))], "net string, seq long, kind int, score double, mag double")
    order = sorted(range(60), key=lambda i: (-s[i], i))
    hits = np.array([y[i] > 0 for i in order], dtype=float)
    want = (np.cumsum(hits) / np.arange(1, 61) * hits).sum() / hits.sum()
    assert metrics.average_precision(rows, F.col("kind") > 0).first().ap == pytest.approx(want)
    assert metrics.average_precision(rows.where("kind = 0"), F.col("kind") > 0).first().ap is None
    d = metrics.detection(rows).first()
    assert d.base == pytest.approx((y > 0).mean()) and d.recall == pytest.approx((s[y > 0] > 0).mean()) and d.precision == pytest.approx((y[s > 0] > 0).mean())
    assert metrics.detection(rows, at=99.0).first().precision is None
    k = int((y > 0).sum())
    assert metrics.precision_at_k(rows, "net").first().p_at_k == pytest.approx(np.mean([y[i] > 0 for i in order[:k]]))
    bins = {r.lo: (r.n, r.recall) for r in metrics.by_magnitude(rows).collect()}
    assert bins[5.0][0] == (y == 1).sum() and bins[15.0] == (0, None)
    assert metrics.by_magnitude(rows.withColumn("mag", F.lit(500.0))).agg(F.sum("n")).first()[0] == 0
    ranked = spark.createDataFrame([("q", 3.0, False), ("q", 2.0, True), ("q", 2.0, False), ("r", 1.0, True), ("s", 1.0, False)], "q string, score double, is_target boolean")
    assert {r.q: (r.rank, r.n) for r in metrics.rank_of_truth(ranked, "q").collect()} == {"q": (2, 3), "r": (1, 1)}


@pytest.fixture(scope="module")
def samples(spark):
    from tests.conftest import DDL

    rows = [(f"n{k}", i, 10.0 + i, 1e-3, 1e-3, f"0 {i + 1}", f"0 {i}", "00Test.1") for k in range(2) for i in range(24)] + [(f"n{k}", 99, 21.0, 1e-3, 1e-3, "0 2", "0 0", "00Test.1") for k in range(2)]
    t = spark.createDataFrame(rows, DDL)
    both = training.refit_samples(t, n_samples=6).unionByName(training.corrupted_samples(t, n_graphs=2, fraction=0.2)).unionByName(training.linked_samples(t, n_graphs=1, n_neg=5))
    return t, training.written(both, "samples")


def test_gradients(samples):
    p = model.initial(1, hidden=6, layers=2)
    for r in samples[1].collect():
        g = model.unpacked(bytes(r["sample"]))
        _, grads = model.gradient(p, g)
        for k in ("conv0.att", "conv0.src", "conv1.edge", "norm1.shift", "unc.w1", "outlier.w2", "link.w1", "fix.w1"):
            i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
            at = []
            for d in (1e-6, -1e-6):
                q = {a: b.copy() for a, b in p.items()}
                q[k][i] += d
                at.append(float(model.loss_of(model.leaves(q), g).data))
            assert (at[0] - at[1]) / 2e-6 == pytest.approx(grads[k][i], rel=1e-3, abs=1e-5)


def test_training_lowers_the_loss_and_weights_round_trip(samples, spark, tmp_path):
    losses = []
    p = model.train(samples[1], epochs=10, check_every=3, rate=1e-2, start=model.initial(1, hidden=8, layers=2), log=lambda e, a, b: losses.append(b))
    assert losses[-1] < losses[0]
    model.save(spark, p, str(tmp_path / "w"))
    q = model.load(spark, str(tmp_path / "w"))
    assert p.keys() == q.keys() and all(np.array_equal(p[k], q[k]) for k in p)


def test_link_head_is_symmetric():
    p = model.leaves(model.initial(0, hidden=8, layers=1))
    rng = np.random.default_rng(0)
    a, b = model.Value(rng.normal(size=(5, 8))), model.Value(rng.normal(size=(5, 8)))
    qa, qb = rng.normal(size=(5, 7)), rng.normal(size=(5, 7))
    assert np.allclose(model.link_logits(p, a, b, qa, qb).data, model.link_logits(p, b, a, qb, qa).data)


def test_reports(samples, spark):
    from tests.conftest import DDL

    t, _ = samples
    p = model.initial(3, hidden=8, layers=2)
    p["outlier.b2"] = np.array([5.0])
    r = training.advise_corrections(t.where("net = 'n0'"), p)
    assert r.columns == ["net", "seq", "ref", "upper", "lower", "proposed_upper", "outlier_p", "confidence"] and r.count() > 0
    assert r.where("confidence <= 0 or confidence > 1 or proposed_upper = upper").count() == 0
    off = spark.createDataFrame([("n0", 1, 12.0, 1e-3, 1e-3, "0 51", "0 50", "x.1", 1)], DDL + ", orphan int")
    links = training.advise_links(t.where("net = 'n0'"), off, p)
    assert [x.rank for x in links.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    assert training.calibration(t, p, n_samples=3).count() == 2


def test_draws_in_tasks_are_those_of_columns(spark, net):
    """Refits and bootstraps draw in the task; the lines they keep and the uncertainties are those of the column forms."""
    t = net([(10.0 + i, 0.1 * (1 + i % 3), f"0 {i % 7 + 1}", f"0 {i % 5}") for i in range(31) if i % 7 + 1 != i % 5], "n|x")
    e = solve.solve_energies(t).where("comp = 1").persist()
    main = t.join(e.select("net", F.col("level").alias("upper")), ["net", "upper"])
    kept = simulate.masked(main, n_samples=20, mask_fraction=0.3, seed=5)
    want = {}
    for r in kept.select("sample", "upper", "lower").collect():
        want.setdefault(r["sample"], []).append((r["upper"], r["lower"]))
    ground = e.orderBy("energy").first()["level"]
    got = {}
    for r in simulate.refit_errors(main, e, n_samples=20, mask_fraction=0.3, seed=5).collect():
        got.setdefault(r["sample"], set()).add(r["level"])
    for k, lines in want.items():
        seen = {ground}
        while more := {y for a, b in lines for y in (a, b) if a in seen or b in seen} - seen:
            seen |= more
        assert got.get(k, {ground}) == seen
    drawn = solve.resampled(t, iterations=19, seed=3)
    one = solve.solve_energies(drawn.where("sample = 17"), unc="drawn").collect()
    two = solve.bootstrap_samples(t, iterations=19, seed=3).where("sample = 17").collect()
    assert {(r["level"], round(r["energy"], 9)) for r in one} == {(r["level"], round(r["energy"], 9)) for r in two}


def test_shuffle_does_not_follow_samples(spark, net):
    t = net([(1.0, 0.1, "b", "a"), (2.0, 0.1, "c", "a")])
    assert solve.sample_blocks(t, 1000).count() == solve.sample_blocks(t, 100_000).count() == solve.BLOCKS * 2
