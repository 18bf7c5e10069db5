"""Nets of more lines than a task takes: the same rows as those of whole nets."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineweave.operators import features, model, network, solve
from lineweave.session import attach
from lineweave.sources import adapters

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small(monkeypatch):
    """A task takes few lines, so that nets fall into blocks and parts."""
    return lambda: monkeypatch.setattr(network, "LINES", 25)


def test_components_of_blocks(spark, small):
    t = adapters.transitions(attach(spark), SF)
    # a level may be the upper end of one line and the lower end of another
    mixed = t.withColumn("lower", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("1 "), F.col("seq"))).otherwise(F.col("lower")))
    whole = [_rows(network.components(x)) for x in (t, mixed)]
    small()
    assert network.sizes(t, network.LINES) is not None
    for x, rows in zip((t, mixed), whole):
        assert _rows(network.components(x)) == rows
        assert _rows(network.components(x, method="distributed")) == rows


def test_links_are_settled_in_shards(spark, monkeypatch):
    """Star rounds come only where a net has more links than a task takes, and then over stars of shards."""
    t = adapters.transitions(attach(spark), SF).where("net like '1995%'")
    whole, runs, rounds = _rows(network.components(t)), [], network.star_components
    monkeypatch.setattr(network, "star_components", lambda *a: runs.append(a[0].count()) or rounds(*a))
    assert _rows(network.components(t, method="distributed")) == whole and not runs
    monkeypatch.setattr(network, "SHARD", 4)
    assert _rows(network.components(t, method="distributed")) == whole and runs[0] > 0


def test_parts_have_whole_components(spark, small):
    t = adapters.transitions(attach(spark), SF)
    small()
    lines = network.parted(t)
    comps = network.with_component(lines, network.components(t))
    both = comps.groupBy("net", "comp").agg(F.countDistinct("_part").alias("p"), F.countDistinct("_top").alias("t"))
    assert both.where("p > 1 or t > 1").count() == 0
    assert lines.select("net", "_part").distinct().groupBy("net").count().where("count > 1").count() > 0


def test_solves_of_parts(spark, small):
    c = adapters.consistent(attach(spark), SF)
    e = solve.solve_energies(c)
    rounded = lambda df: _rows(df.select(*[F.round(x, 7).alias(x) if t == "double" else x for x, t in df.dtypes]))
    run = {
        "energies": lambda: solve.solve_energies(c),
        "paths": lambda: solve.path_uncertainty(c, e),
        "paths without components": lambda: solve.path_uncertainty(c, e.drop("comp")),
        "samples": lambda: solve.bootstrap_samples(c, iterations=2),
        "network": lambda: solve.solve_network(c, bootstrap_iterations=2),
        "leverages": lambda: features.leverages(c),
        "bridges": lambda: network.bridges(c),
    }
    whole = {k: rounded(f()) for k, f in run.items()}
    e = spark.createDataFrame(e.collect(), e.schema)
    small()
    for k, f in run.items():
        assert rounded(f().select(*whole_columns(k))) == whole[k], k


def whole_columns(k):
    return {
        "energies": ["net", "comp", "idx", "level", "energy"], "samples": ["net", "comp", "idx", "level", "energy", "sample"], "network": ["net", "comp", "level", "energy", "unc"],
        "leverages": ["net", "seq", "leverage", "bridge"], "bridges": ["net", "a", "b"],
    }.get(k, ["net", "comp", "level", "sp_unc"])


def test_model_scores_parts(spark, monkeypatch):
    """No task meets more levels than it should, and parts are scored as whole nets are."""
    c = adapters.consistent(attach(spark), SF)
    nodes, edges = features.build_graph(c)
    p = model.initial(7, hidden=8, layers=2)
    widths = lambda: {r[:2]: r[2] for r in model.score_levels(nodes, edges, p).select("net", "level", "log_sigma").collect()}
    logits = lambda: {r[:2]: r[2] for r in model.score_lines(nodes, edges, p).collect()}
    whole = widths(), logits()
    monkeypatch.setattr(model, "LEVELS", 20)
    most = lambda g: g.applyInPandas(lambda n, e: pd.DataFrame({"n": [n["net"].count()], "comps": [n["comp"].nunique()]}), "n long, comps long").where("comps > 1").agg(F.max("n")).first()[0]
    assert most(model._scored(nodes, edges)) < most(model._together(nodes, edges))
    for rows, before in zip((widths(), logits()), whole):
        assert rows.keys() == before.keys() and all(rows[k] == pytest.approx(before[k]) for k in rows)


def test_few_samples_share_a_copy_of_the_lines(spark, monkeypatch):
    """As many copies as tasks are needed for the samples, and the same samples however many tasks share them."""
    c = adapters.consistent(attach(spark), SF).where("net like '1995-0%'")
    copies = lambda n: solve.sample_blocks(c, n).count() / c.count()
    assert [copies(n) for n in (1, 5, 6, 200)] == [1, 1, 2, 16]
    rounded = lambda: _rows(solve.bootstrap_samples(c, iterations=7).withColumn("energy", F.round("energy", 7)))
    few = rounded()
    monkeypatch.setattr(solve, "SAMPLES", 1)
    assert rounded() == few and {r[-1] for r in few} == set(range(7))


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    """What is written keeps no files of the shuffles before it, and the session's setting is as before."""
    from lineweave import session

    before = spark.conf.get(session.CLEANUP)
    t = session.written(adapters.transitions(attach(spark), SF), "lines")  # by a window, so by a shuffle
    assert spark.conf.get(session.CLEANUP) == before and t.count() == adapters.transitions(spark, SF).count()
    assert all(f.endswith(".zstd.parquet") for f in (r[0] for r in t.select("_metadata.file_name").distinct().collect()))
