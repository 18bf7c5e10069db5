"""Steps whose cost or memory once grew beyond their input: tables sent whole to executors, lines computed more than once."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineweave.functions.scalars import NUMBER, tokens
from lineweave.operators import network, solve, units
from lineweave.plans import queries
from lineweave.sources import adapters
from lineweave.sources import lines as L

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_potentials_are_not_sent_whole(spark):
    for f in (adapters.published, adapters.consistent):
        assert "BroadcastHashJoin" not in plan(f(spark, SMALL))


def test_levels_of_both_sides_are_counted_in_one_pass(spark):
    a = spark.createDataFrame([("n", "x"), ("n", "x"), ("n", "y"), ("n", None)], "net string, level string")
    b = spark.createDataFrame([("n", "x"), ("n", None), ("m", "z"), ("m", "z")], "net string, level string")
    d = solve.levels_difference(a, b)
    assert plan(d).count("Scan ExistingRDD") == 2  # four before
    assert sorted(map(tuple, d.collect())) == [("m", "z", "published"), ("m", "z", "published"), ("n", "x", "computed"), ("n", "y", "computed")]


def numbered(t):
    """Lines with a window under them, which shows wherever they are computed."""
    return t.withColumn("seq", F.row_number().over(Window.partitionBy("net").orderBy("seq")).cast("long"))


def test_lines_to_be_labelled_are_written_first(spark, net):
    t = numbered(net([(1.0, 1e-3, "b", "a"), (1.0, 1e-3, "c", "b"), (1.0, 1e-3, "y", "x")]))
    found = network.largest_component(t)
    assert "Window" not in plan(found)
    assert sorted(r.lower for r in found.collect()) == ["a", "b"]


def test_native_lines_are_written_before_they_are_parsed(spark):
    assert "Window" not in plan(queries.QUERIES["q_parse_with_segments"](spark, SMALL))


def test_units_are_counted_in_one_pass(spark, net):
    t = net([(1.0, 1e-3, "b", "a"), (-1.0, 1e-3, "b", "a"), (1.0, 1e-3, "c", "a"), (3.0, 1e-3, "b", "a")])
    t = t.withColumn("ref", F.when(F.col("upper") == "c", "11Lone.1").otherwise(F.col("ref")))
    lv = spark.createDataFrame([("n", "a", 0.0), ("n", "b", 1.0)], "net string, level string, energy double")
    report = units.unit_report(t, lv)
    assert plan(report).count("Scan ExistingRDD") == 3  # four before, as tags were read apart
    assert {(r["tag"], r["lines"], r["n_cm-1"]) for r in report.collect()} == {("00Test", 2, 1), ("11Lone", 0, 0)}


def kind_by_tokens(value):
    """The class of a line as the tokens tell it."""
    tok = tokens(value)
    numeric = lambda i: F.coalesce(F.get(tok, F.lit(i)).rlike(NUMBER), F.lit(False))
    return (
        F.when(F.startswith(value, F.lit(L.DIVIDER)), "divider").when(F.size(tok) == 0, "blank").when(F.contains(value, F.lit("&")), "comment").when(F.startswith(F.get(tok, F.lit(0)), F.lit("#")), "marked")
        .when(F.size(tok) < 5, "short").when(numeric(0) & numeric(1) & numeric(2) & (F.size(tok) >= 6), "data").otherwise("words")
    )


def test_classes_of_lines_without_taking_them_apart(spark):
    parts = ["1.5", "+.5e-3", "5.", "nan", "Infinity", "-INF", "inff", "1e", "1.2.3", "#1", "x", "&", "0"]
    odd = ["", " ", "\t\x0b\f", "-" * 40 + " 1", "# 1 2 3 4 5", "  #1 2 3 4 5 6", "1 2 3 4", "1 2 3 4 5", "1 2 3 4 5 6", " 1 2 3 4 5 6 ", "1\x0b2\f3\t4 5 6", "1 2 3 4 5 ", "1 2 x 4 5 6", "1 2 3 & 5 6", "1 2 3 4 5 6 7"]
    some = odd + [" ".join([a, b, c, "0", "1", "r"]) for a in parts for b in parts[:6] for c in parts[3:]]
    rows = spark.createDataFrame([(s,) for s in some], "value string").select("value", L.line_kind(F.col("value")).alias("k"), kind_by_tokens(F.col("value")).alias("t"), L.may_have_data(F.concat(F.lit("head\r"), "value", F.lit("\ntail"))).alias("may"))
    found = rows.collect()
    assert [json.dumps(r.value) for r in found if r.k != r.t] == []
    assert all(r.may for r in found if r.k == "data") and not all(r.may for r in found)
    assert "split(" not in rows.select(L.line_kind(F.col("value")))._jdf.queryExecution().optimizedPlan().toString()


def test_lines_do_not_meet_by_their_few_tags(spark):
    seg = spark.createDataFrame([("AF", "MHz")], "tag string, unit string")
    assert "SortMergeJoin" not in plan(L.convert_units(adapters.transitions(spark, SMALL), seg))
    assert "SortMergeJoin" not in plan(L.with_fault(adapters.transitions(spark, SMALL), seg))
