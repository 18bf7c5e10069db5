"""Incremental inversion: takes the line files that are new, and solves the networks that they touch.

    python -m jobs.refresh_networks LINES OUT --levels NAME=PATH ... [--config FILE]

LINES is a folder (or one file) of Parquet with measured lines; files are added to it over time.  The configuration gives SQL expressions
over its columns for the columns of transitions, and says where frequencies come from: an expression, or a table of published levels, whose
differences then stand for measured frequencies (to check an assignment before frequencies are known).

Under OUT are written
    lines/      the transitions taken so far, partitioned by a hash of the network and by batch
    energies/   (net, comp, level, energy, unc), partitioned by network; only networks with new lines are written anew
    checkpoint/ the stream's checkpoint: which files have been taken

A line that is delivered again, with its ``seq`` and levels, replaces the older one.  A batch that is run again after a failure replaces its own files, and
a network is always solved from all its lines, so a rerun ends with the same result; a run without new files changes nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.operators import solve
from lineweave.session import attach, written
from lineweave.sources import lines as sources

log = logging.getLogger("jobs.refresh_networks")

#: Parts of the lines table: a batch reads only the parts that its networks are in.
PARTS = 256
CONFIG = Path(__file__).with_suffix(".json")
COLUMNS = ("net", "seq", "freq", "unc", "orig_unc", "upper", "lower", "ref")
STORED = "net string, seq long, freq double, unc double, orig_unc double, upper string, lower string, ref string, part int, batch long"
ENERGIES = "comp int, level string, energy double, unc double, net string"


def load(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def transitions(raw: DataFrame, levels: DataFrame | None, config: dict) -> DataFrame:
    """Rows of the line files as transitions.  Lines whose levels aren't published have no frequency and are left out, if levels give it."""
    shaped = raw.select(*[F.expr(config["lines"][c]).alias(c) for c in COLUMNS if c in config["lines"]])
    if levels is not None:
        up, low = (levels.select(F.col("level").alias(end), F.col("energy").alias(f"e_{end}")) for end in ("upper", "lower"))
        shaped = shaped.join(up, "upper").join(low, "lower").withColumn("freq", F.round(F.col("e_upper") - F.col("e_lower"), config.get("digits", 6)))
    ready = shaped.withColumn("excluded", F.coalesce(F.col("freq") < 0, F.lit(False)))
    return sources.kept(sources.checked(ready)).select(F.col("net").cast("string"), F.col("seq").cast("long"), *[F.col(c).cast("double") for c in COLUMNS[2:5]], *COLUMNS[5:])


def published(spark: SparkSession, config: dict, paths: dict[str, str]) -> DataFrame | None:
    """(level, energy) of all level tables that the configuration names."""
    found = None
    for name, columns in config.get("levels", {}).items():
        one = spark.read.parquet(paths[name]).select(F.expr(columns["level"]).alias("level"), F.expr(columns["energy"]).cast("double").alias("energy"))
        found = one if found is None else found.unionByName(one)
    return found


def _pattern(path: str) -> str:
    """A pattern that only ``path`` matches: a stream takes one file by a pattern, but not by its name."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, lines: str, out: str, levels: dict[str, str] | None = None, config: dict | None = None) -> dict[str, int]:
    """Takes all new files of ``lines`` and returns what was done: batches, lines taken, networks and levels written."""
    attach(spark)
    config = config or load()
    given = published(spark, config, levels or {})
    store, energies = f"{out}/lines", f"{out}/energies"
    done = {"batches": 0, "lines": 0, "networks": 0, "levels": 0}

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        part = F.pmod(F.xxhash64("net"), F.lit(PARTS)).cast("int")
        rows = transitions(df, given, config)
        (
            rows.withColumn("part", part).withColumn("batch", F.lit(number).cast("long")).hint("rebalance", "part")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(store)
        )
        whole = session.read.schema(STORED).parquet(store).where(F.col("batch") <= number)
        new = whole.where(F.col("batch") == number)
        n = new.count()
        log.info("batch %d: took %d lines", number, n)
        if not n:
            return
        touched = written(new.select("part", "net").distinct(), "touched")
        parts = [r["part"] for r in touched.select("part").distinct().collect()]  # PARTS numbers at most
        mine = whole.where(F.col("part").isin(parts)).join(touched.select("net"), "net", "left_semi")
        latest = Window.partitionBy("net", "seq", "upper", "lower").orderBy(F.desc("batch"), "unc", "freq")
        current = mine.withColumn("place", F.row_number().over(latest)).where("place = 1").select(*COLUMNS)
        solved = written(solve.solve_network(current, bootstrap_iterations=config.get("bootstrap_iterations", 0), seed=config.get("seed", 0)), "energies")
        solved.hint("rebalance", "net").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("net").parquet(energies)
        nets, levels = touched.count(), solved.count()
        log.info("batch %d: solved %d networks, wrote %d levels to %s", number, nets, levels, energies)
        done["batches"] += 1
        done["lines"] += n
        done["networks"] += nets
        done["levels"] += levels

    schema = spark.read.parquet(lines).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.get("files_per_batch", 1000)).parquet(_pattern(lines))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %(lines)d lines in %(batches)d batches, solved %(networks)d networks, wrote %(levels)d levels", done)
    return done


def result(spark: SparkSession, out: str) -> DataFrame:
    """(net, comp, level, energy, unc) as it stands under ``out``."""
    return spark.read.schema(ENERGIES).parquet(f"{out}/energies").select("net", "comp", "level", "energy", "unc")


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("lines")
    a.add_argument("out")
    a.add_argument("--levels", nargs="*", default=[], metavar="NAME=PATH")
    a.add_argument("--config", default=str(CONFIG))
    x = a.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("refresh_networks").getOrCreate()
    try:
        run(spark, x.lines, x.out, dict(v.split("=", 1) for v in x.levels), load(x.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
