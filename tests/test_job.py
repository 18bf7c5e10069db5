"""The training job from a table file to weights, metrics and reports."""

from lineweave.plans import job


def test_job(spark, tmp_path):
    bar = "-" * 50
    rows = [f"{net} CO {10.0 + i + 0.001 * k} 1e-3 0 {i + 1} 0 {i} 00Test.1" for k, net in enumerate("AB") for i in range(24)] + [f"{net} CO 21.0 1e-3 0 2 0 0 00Test.2" for net in "AB"] + [f"{net} CO 3.0 1e-3 5 1 5 0 00Test.3" for net in "AB"]
    (tmp_path / "t.txt").write_text("\n".join(["Title", bar, *rows]))
    levels = [f"B CO 0 {i} {sum(10.0 + k + 0.001 for k in range(i)):.6f} 1e-3 2" for i in range(25)]
    (tmp_path / "levels.txt").write_text("\n".join(["Title", bar, *levels]))
    p = job.run(spark, str(tmp_path / "t.txt"), str(tmp_path / "out"), ["A"], ["B"], epochs=2, n_refits=3, n_graphs=2, levels=str(tmp_path / "levels.txt"))
    assert "fix.w1" in p
    read = lambda x: spark.read.parquet(str(tmp_path / "out" / x))
    assert read("weights").count() == len(p)
    link, fix = read("metrics/link").first(), read("metrics/fix").first()
    assert 0 < link.mrr <= 1 and link.n_pairs > 0 and 0 <= fix.acc <= 1 and fix.n > 0
    assert read("metrics/calibration").count() == 2 and read("reports/links").where("rank <= 5").count() == 5
    read("reports/corrections").count()
    sanity = read("metrics/sanity").first()
    assert sanity["net"] == "B" and sanity["share"] > 0.5
