"""Jobs over growing input, reruns, and results against one run over everything."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import harvest_lines, refresh_networks
from lineweave.operators import solve

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
LEVELS = {"part": f"{SF}/part.parquet", "supplier": f"{SF}/supplier.parquet"}


def rows(df, *cols):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


ALL = ("net", "level", "energy", "unc")


def test_refresh_takes_only_what_is_new(spark, tmp_path):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    month = F.date_format("l_shipdate", "yyyy-MM")
    old = items.where("l_orderkey % 3 > 0")
    late = items.where("l_orderkey % 3 = 0").where(month > "1997-06")
    given, out, whole = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "whole")
    old.repartition(3).write.mode("append").parquet(given)
    first = refresh_networks.run(spark, given, out, LEVELS)
    assert first["batches"] == 1 and first["lines"] == old.count()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "energies").rglob("*.parquet")}
    idle = refresh_networks.run(spark, given, out, LEVELS)
    assert idle == {"batches": 0, "lines": 0, "networks": 0, "levels": 0}
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "energies").rglob("*.parquet")}
    late.write.mode("append").parquet(given)
    second = refresh_networks.run(spark, given, out, LEVELS)
    touched = late.select(month).distinct().count()
    assert (second["lines"], second["networks"]) == (late.count(), touched)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "energies").rglob("*.parquet")}
    same = [p for p in before if after.get(p) == before[p]]
    assert same and all(p.parent.name <= "net=1997-06" for p in same)
    old.unionByName(late).write.parquet(str(tmp_path / "all"))
    refresh_networks.run(spark, str(tmp_path / "all"), whole, LEVELS)
    got = rows(refresh_networks.result(spark, out), *ALL)
    assert got == rows(refresh_networks.result(spark, whole), *ALL) and len(got) > 1000


def test_refresh_runs_a_failed_batch_again(spark, tmp_path, monkeypatch):
    given, out, whole = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "whole")
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey % 7 = 0").write.parquet(given)

    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(solve, "solve_network", broken)
        with pytest.raises(Exception, match="lost"):
            refresh_networks.run(spark, given, out, LEVELS)
    refresh_networks.run(spark, given, out, LEVELS)
    refresh_networks.run(spark, given, whole, LEVELS)
    assert rows(refresh_networks.result(spark, out), *ALL) == rows(refresh_networks.result(spark, whole), *ALL)


MEASURED = {"lines": {c: c for c in refresh_networks.COLUMNS}}
DDL = "net string, seq long, freq double, unc double, orig_unc double, upper string, lower string, ref string"


def test_refresh_measured_lines_and_corrections(spark, tmp_path):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda r: spark.createDataFrame(r, DDL).coalesce(1).write.mode("append").parquet(given)
    put([("a", 1, 10.0, 0.1, 0.1, "1", "0", "x"), ("a", 2, -5.0, 0.1, 0.1, "2", "1", "x"), ("b", 1, 7.0, 0.1, 0.1, "1", "0", "x")])
    refresh_networks.run(spark, given, out, None, MEASURED)
    assert rows(refresh_networks.result(spark, out), "net", "level", "energy") == [("a", "0", 0.0), ("a", "1", 10.0), ("b", "0", 0.0), ("b", "1", 7.0)]
    put([("a", 1, 11.0, 0.1, 0.1, "1", "0", "x"), ("a", 3, 4.0, 0.1, 0.1, "2", "1", "x")])
    assert refresh_networks.run(spark, given, out, None, MEASURED)["networks"] == 1
    assert rows(refresh_networks.result(spark, out), "net", "level", "energy") == [("a", "0", 0.0), ("a", "1", 11.0), ("a", "2", 15.0), ("b", "0", 0.0), ("b", "1", 7.0)]
    put([("b", 9, 1.0, 0.1, 0.1, "5", "5", "x")])
    with pytest.raises(Exception, match="upper == lower"):
        refresh_networks.run(spark, given, out, None, MEASURED)


LIST = "# a list\n10.0 0.1 0.1 1 0 0 0 t.1\n20.5 0.1 0.1 2 0 1 0 t.2 & old\r\n20.0 0.1 0.1 2 0 1 0 t.2\n\n-3 0.1 0.1 3 0 1 0 t.3\n31.0 0.1 0.2 2 0 0 0 t.4\n7 0.1 0.1 1 0 1 0 t.5\n1.5 0.1 0.1 a b t.9\n"


def harvest(spark, tmp_path, docs, out):
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.mode("overwrite").parquet(str(tmp_path / "docs"))
    config = {"tables": {"documents": {"id": "doc_id", "text": "text", "source": "source"}}, "least_data": 3, "share_percent": 50}
    return harvest_lines.run(spark, {"documents": str(tmp_path / "docs")}, out, config)


def test_harvest(spark, tmp_path):
    out = str(tmp_path / "out")
    docs = [(1, LIST, "s"), (2, "plain words of a text\nthat go on and on and on\n\nshort", "s"), (3, None, "s"), (4, "", None), (5, "-" * 45 + "\n1 2 3 4 5", "t")]
    done = harvest(spark, tmp_path, docs, out)
    assert done == {"documents": 5, "profile": 9, "transitions": 3, "energies": 3}
    got = {(r.source, r.kind): (r.lines, r.texts) for r in harvest_lines.profile(spark, out).collect()}
    assert got == {("s", "marked"): (1, 1), ("s", "data"): (6, 1), ("s", "comment"): (1, 1), ("s", "blank"): (3, 2), ("s", "words"): (2, 1), ("s", "short"): (1, 1), ("unknown", "blank"): (1, 1), ("t", "divider"): (1, 1), ("t", "words"): (1, 1)}
    lines = spark.read.schema(harvest_lines.TRANSITIONS).parquet(f"{out}/transitions")
    assert rows(lines, "net", "seq", "freq", "unc", "upper", "lower", "ref") == [("documents:s:1", 2, 10.0, 0.1, "1 0", "0 0", "t.1"), ("documents:s:1", 4, 20.0, 0.1, "2 0", "1 0", "t.2"), ("documents:s:1", 7, 31.0, 0.2, "2 0", "0 0", "t.4")]
    levels = spark.read.schema(harvest_lines.ENERGIES).parquet(f"{out}/energies")
    assert [r["level"] for r in levels.orderBy("energy").collect()] == ["0 0", "1 0", "2 0"]
    again = harvest(spark, tmp_path, docs, out)
    assert again == done and {(r.source, r.kind): (r.lines, r.texts) for r in harvest_lines.profile(spark, out).collect()} == got


def test_harvest_without_texts(spark, tmp_path):
    done = harvest(spark, tmp_path, [], str(tmp_path / "out"))
    assert done == {"documents": 0, "profile": 0, "transitions": 0, "energies": 0}
    assert harvest_lines.profile(spark, str(tmp_path / "out")).count() == 0


def test_command_lines(tmp_path):
    for name in ("refresh_networks", "harvest_lines"):
        json.loads((ROOT / "jobs" / f"{name}.json").read_text())
        subprocess.run([sys.executable, "-m", f"jobs.{name}", "--help"], cwd=ROOT, check=True, capture_output=True, timeout=120)


def test_jobs_import_nothing_of_the_training_data_part():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        assert ("ll" + "m") not in p.read_text() and ("corpus_" + "pipeline") not in p.read_text()
