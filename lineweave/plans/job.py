"""Training job: machine-readable tables to weights, metrics and advisory reports.

    python -m lineweave.plans.job TABLE OUT --train NET ... --validate NET ... [--epochs N] [--levels TABLE]

With ``--levels``, a table of published levels, ``metrics/sanity`` tells how many levels of the validation networks lie within their uncertainties.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, model, network
from ..session import attach, written
from ..sources import lines
from . import training


def run(spark: SparkSession, table: str, out: str, train: list[str], validate: list[str], *, epochs: int = 1000, n_refits: int = 200, n_graphs: int = 30, seed: int = 0, levels: str | None = None) -> model.Params:
    """Writes ``weights``, one table per metric and the two reports under ``out``; returns the weights."""
    rows = written(lines.kept(lines.parse_mrt_transitions(lines.read_lines(attach(spark), table))), "lines")
    given, held = rows.where(F.col("net").isin(train)), rows.where(F.col("net").isin(validate))
    published = None if levels is None else written(lines.parse_mrt_levels(lines.read_lines(spark, levels)), "levels")
    p = training.train_model(given, held, epochs=epochs, n_refits=n_refits, n_graphs=n_graphs, seed=seed)
    model.save(spark, p, f"{out}/weights")
    for name, found in training.evaluation(held, p, n_graphs=n_graphs, published=published).items():
        found.write.mode("overwrite").parquet(f"{out}/metrics/{name}")
    labelled, _ = network.split_components(held, minsize=2)
    main = labelled.where("comp = 1").select(*held.columns)
    off = labelled.where("comp > 1").select(*held.columns, F.col("comp").alias("orphan"))
    training.advise_corrections(main, p).write.mode("overwrite").parquet(f"{out}/reports/corrections")
    training.advise_links(main, off, p).write.mode("overwrite").parquet(f"{out}/reports/links")
    for name, order in (("corrections", (F.desc("outlier_p"), "net", "seq")), ("links", ("net", "orphan", "rank"))):
        metrics.preview(spark.read.parquet(f"{out}/reports/{name}"), *order).show(truncate=False)
    return p


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("table")
    a.add_argument("out")
    a.add_argument("--train", nargs="+", required=True)
    a.add_argument("--validate", nargs="+", required=True)
    a.add_argument("--epochs", type=int, default=1000)
    a.add_argument("--levels")
    x = a.parse_args()
    run(SparkSession.builder.getOrCreate(), x.table, x.out, x.train, x.validate, epochs=x.epochs, levels=x.levels)


if __name__ == "__main__":
    main()
