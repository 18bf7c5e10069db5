"""Parsers: rules, order and errors."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lineweave.functions.scalars import LIGHT_CM_S, qn_vector, shifted, tag
from lineweave.operators import units
from lineweave.plans import inversion
from lineweave.sources import lines as L
from lineweave.streaming import lines as S


def as_lines(spark, text, net="n"):
    return spark.createDataFrame([(net, i, v) for i, v in enumerate(text.split("\n"), 1)], "net string, line_no long, value string")


def test_rules_of_native_lines(spark):
    text = "& note\n2112.5 1e-4 0 0 1 0 0 20AaBb.1\nshort line\n# 1 2 3 4 5 6 7 8\n-10.0 1e-4 2e-4 0 1 0 1 20AaBb.2\n30.0 3e-4 1e-4 1 4 0 3 20AaBb.3 more\n  "
    rows = L.parse_native(as_lines(spark, text)).orderBy("seq").collect()
    assert [(r.seq, r.excluded) for r in rows] == [(2, False), (5, True), (6, False)]
    assert rows[0].unc == 1e-6 and rows[0].orig_unc == 1e-4 and rows[0].upper == "0 1" and rows[0].lower == "0 0"
    assert rows[2].ref == "20AaBb.3" and rows[2].unc == 1e-4 and rows[2].orig_unc == 3e-4


def test_count_of_tokens_is_that_of_the_first_line(spark):
    r = L.parse_native(as_lines(spark, "# c\n1.5 1e-3 1e-3 5 0 1 1 0 1 e 4 0 0 0 0 1 e 21Xx.7")).first()
    assert (r.upper, r.lower, r.ref) == ("5 0 1 1 0 1 e", "4 0 0 0 0 1 e", "21Xx.7")


def test_self_loop_raises_only_if_kept(spark):
    with pytest.raises(PySparkException, match="upper == lower"):
        L.parse_native(as_lines(spark, "100.0 1e-4 1e-4 0 1 0 1 20AaBb.1")).collect()
    assert L.parse_native(as_lines(spark, "-100.0 1e-4 1e-4 0 1 0 1 20AaBb.1")).first().excluded


def test_units(spark):
    seg = spark.createDataFrame([("70RoDo", "MHz"), ("99Zz", "cm-1")], "tag string, unit string")
    r = L.parse_native(as_lines(spark, "115271.2018 0.005 0 0 1 0 0 70RoDo.1"), segments=seg).first()
    k = 1e6 / LIGHT_CM_S
    assert r.freq == pytest.approx(115271.2018 * k) and r.unc == pytest.approx(1e-6 * k) and r.orig_unc == pytest.approx(0.005 * k)
    with pytest.raises(PySparkException, match="missing segment: 71Aa"):
        L.parse_native(as_lines(spark, "-1.0 1 1 0 1 0 0 71Aa.1"), segments=seg).collect()


def test_bad_numbers_raise(spark):
    for bad in ("1d", "1_0", "x"):
        with pytest.raises(PySparkException):
            L.parse_native(as_lines(spark, f"{bad} 1 1 0 1 0 0 a.1")).select("freq").collect()


def test_levels_and_tables(spark):
    lv = {r.level: r for r in L.parse_native_levels(as_lines(spark, "# c\n0 0 0.0 1e-6 8\n0 1 3.8 1e-6 5\n0 1 3.9 2e-6 6\nx 1")).collect()}
    assert lv["0 1"].energy == 3.9 and lv["0 1"].n_trans == 6 and len(lv) == 2
    bar = "-" * 44
    t = L.parse_mrt_transitions(as_lines(spark, f"head\n{bar}\nx\n{bar}\n\nA CO 3.7 0 0 1 0 0 03Kl.1\nA CO -2.0 1e-3 1 1 1 1 03Kl.2")).orderBy("seq").collect()
    assert [(r.net, r.freq, r.unc, r.orig_unc, r.excluded) for r in t] == [("A", 3.7, 1e-6, 1e-6, False), ("A", -2.0, 1e-3, 1e-3, True)]
    e = L.parse_mrt_levels(as_lines(spark, f"{bar}\nA CO 0 1 3.7 1e-6 8")).first()
    assert (e.net, e.level, e.energy, e.n_trans) == ("A", "0 1", 3.7, 8)
    with pytest.raises(PySparkException, match="no divider"):
        L.parse_mrt_levels(as_lines(spark, "A CO 0 1 3.7 1e-6 8")).collect()


def test_files_have_line_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny\r\nz")
    (tmp_path / "b.txt").write_text("".join(f"line {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {(r.net, r.line_no): r.value for r in L.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["a", 1] == "x" and got["a", 3] == "y" and got["a", 4] == "z"
    assert all(got["b", i + 1] == f"line {i}" for i in range(3000)) and len(got) == 3004


def test_inferred_units_and_inversion(spark, tmp_path):
    e = {"0 0": 0.0, "0 1": 4.0, "0 2": 12.0, "0 3": 24.0}
    k = LIGHT_CM_S / 1e6
    rows = [f"{e[a] - e[b]} 1e-3 1e-3 {a} {b} 01Cm.1" for a, b in (("0 1", "0 0"), ("0 2", "0 1"))] + [f"{(e[a] - e[b]) * k} {1e-3 * k} {1e-3 * k} {a} {b} 02Mh.1" for a, b in (("0 3", "0 2"), ("0 2", "0 0"))] + ["-5.0 1e-3 1e-3 0 1 0 2 03No.1"]
    (tmp_path / "list.txt").write_text("\n".join(rows))
    (tmp_path / "lv").mkdir()
    (tmp_path / "lv" / "list.txt").write_text("\n".join(f"{a} {x} 1e-6 3" for a, x in e.items()))
    energies, segments, report = inversion.from_unlabelled_files(spark, str(tmp_path / "list.txt"), str(tmp_path / "lv" / "list.txt"))
    assert {r.tag: r.unit for r in segments.collect()} == {"01Cm": "cm-1", "02Mh": "MHz", "03No": "cm-1"}
    assert {r.tag: r["lines"] for r in report.collect()} == {"01Cm": 2, "02Mh": 2, "03No": 0}
    assert {r.level: round(r.energy, 9) for r in energies.collect()} == e
    direct = inversion.from_native_files(spark, str(tmp_path / "list.txt"), segments=segments.select("tag", "unit"))
    assert {r.level: round(r.energy, 9) for r in direct.collect()} == e


def test_closure(spark, net):
    lv = spark.createDataFrame([("n", "a", 0.0), ("n", "b", 1.0)], "net string, level string, energy double")
    r = units.closure(net([(1.0, 1e-3, "b", "a"), (1.1, 1e-3, "b", "a"), (1.0, 1e-3, "c", "a")]), lv).first()
    assert (r["lines"], r.checked, r.misses) == (3, 2, 1)


def test_scalars(spark):
    df = spark.createDataFrame([("3 0 1 1 0 2 f", "15Ca.1.2"), ("0 1", "plain")], "level string, ref string")
    r = df.select(qn_vector(F.col("level")).alias("q"), tag(F.col("ref")).alias("t"), shifted(F.col("level"), 1, F.lit(-1)).alias("s")).collect()
    assert r[0].q == [3, 0, 1, 1, 0, 2, 1] and r[1].q == [0, 1, 0, 0, 0, 0, 0]
    assert [x.t for x in r] == ["15Ca", "plain"] and [x.s for x in r] == ["3 -1 1 1 0 2 f", "0 0"]
    for bad in ("0 z", "1 2 3 4 5 6 7 8"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "level string").select(qn_vector(F.col("level"))).collect()


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("n\t1\t10.0 1e-3 1e-3 0 1 0 0 a.1\nn\t2\t-1.0 1e-3 1e-3 0 1 0 0 a.2\n")
    got = []
    for more in (None, "n\t3\t5.0 1e-3 1e-3 0 2 0 1 a.3\nm\t1\t2.0 1e-3 1e-3 0 1 0 0 a.1\n"):
        if more:
            (tmp_path / "in" / "2.txt").write_text(more)
        q = S.solve_touched(S.read_stream(spark, str(tmp_path / "in"), nqn=2), str(tmp_path / "store"), lambda df, n: got.append({(r.net, r.level): r.energy for r in df.collect()}), str(tmp_path / "check"))
        q.awaitTermination(60)
        assert q.exception() is None
    assert got[0] == {("n", "0 1"): 10.0, ("n", "0 0"): 0.0}
    assert got[1] == {("n", "0 0"): 0.0, ("n", "0 1"): 10.0, ("n", "0 2"): 15.0, ("m", "0 0"): 0.0, ("m", "0 1"): 2.0}


def test_checked_write_tells_all_faults(spark, net, tmp_path):
    t = net([(1.0, 0.1, "b", "a"), (2.0, 0.1, "c", "c"), (-3.0, 0.1, "d", "d"), (4.0, 0.1, "e", "a")])
    seg = spark.createDataFrame([("00Test", "cm-1")], "tag string, unit string")
    path = str(tmp_path / "one")
    with pytest.raises(ValueError, match="^1 of self-loop: n line 1: self-loop"):
        L.write_checked(t, path, seg)
    assert spark.read.parquet(path + "/fault=none").count() == 3
    none = spark.createDataFrame([], seg.schema)
    found = {r["fault"]: r["n"] for r in L.write_checked(t, str(tmp_path / "two"), none, fail=False).collect()}
    assert found == {"self-loop": 1, "missing segment": 3}
    assert L.write_checked(net([]), str(tmp_path / "three")).count() == 0
    assert [tuple(r) for r in L.write_checked(t.where("seq = 0"), str(tmp_path / "four")).collect()] == [("none", 1)]
