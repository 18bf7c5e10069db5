"""Harvest: looks for line lists in a text corpus, profiles its lines by source, and solves what it found.

    python -m jobs.harvest_lines OUT NAME=PATH ... [--config FILE]

Line lists are often published as plain text among other texts (supplements, mails, crawled pages).  Every line of every text is put into the class
that the native parser gives it (see ``lineweave.sources.lines.line_kind``).  A text of which at least ``least_data`` lines are data with one
number of tokens, and these are ``share_percent`` of its lines that aren't blank or comments, is taken for a line list; its data lines are parsed, and its
network is split into components and solved.  Texts of one table, source and id are one list.

Under OUT are written, each partitioned by source
    profile/      (origin, kind, lines, texts, chars, source): how many lines of each kind there are, and in how many texts
    transitions/  the transitions of the lists found, ``net`` being origin:source:id
    energies/     (net, comp, level, energy, unc) of these

A rerun replaces all three by the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions.scalars import tokens
from lineweave.operators import solve
from lineweave.session import attach, written
from lineweave.sources import lines as sources

log = logging.getLogger("jobs.harvest_lines")

#: Source of texts that name none.
UNKNOWN = "unknown"
CONFIG = Path(__file__).with_suffix(".json")
PROFILE = "origin string, kind string, lines long, texts long, chars long, source string"
TRANSITIONS = "net string, seq long, freq double, unc double, orig_unc double, upper string, lower string, ref string, source string"
ENERGIES = "net string, comp int, level string, energy double, unc double, source string"


def load(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def texts(spark: SparkSession, paths: dict[str, str], config: dict) -> DataFrame:
    """(origin, source, id, text) of all tables; texts that are null go."""
    found = None
    for name, path in paths.items():
        c = config["tables"][name]
        one = spark.read.parquet(path).select(F.lit(name).alias("origin"), F.coalesce(F.expr(c["source"]).cast("string"), F.lit(UNKNOWN)).alias("source"), F.expr(c["id"]).cast("string").alias("id"), F.expr(c["text"]).alias("text"))
        found = one if found is None else found.unionByName(one)
    return found.where(F.col("text").isNotNull())


def kinds(rows: DataFrame) -> DataFrame:
    """(origin, source, kind, lines, texts, chars): the lines of a text are counted where the text is, so one small row leaves for each of its kinds."""
    line = sources.text_lines(F.col("text"))
    each = F.transform(line, lambda x: F.struct(sources.line_kind(x).alias("kind"), F.length(x).cast("long").alias("chars")))
    of = lambda k: F.filter(F.col("each"), lambda x: x["kind"] == k)
    apart = F.array(*[F.struct(F.lit(k).alias("kind"), of(k).alias("of")) for k in sources.LINE_KINDS])
    some = rows.select("origin", "source", each.alias("each")).select("origin", "source", F.inline(apart)).where(F.size("of") > 0)
    chars = F.aggregate("of", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    long = some.select("origin", "source", "kind", F.size("of").cast("long").alias("lines"), chars.alias("chars"))
    return long.groupBy("origin", "source", "kind").agg(F.sum("lines").alias("lines"), F.count("*").alias("texts"), F.sum("chars").alias("chars"))


def lists(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """(source, net, line_no, value): the data lines of texts that are line lists.

    One search passes by texts without a data line; the others are looked at as a whole by expressions, and only those that qualify are taken apart.
    """
    line = sources.text_lines(F.col("text"))
    data = F.filter(line, lambda x: sources.line_kind(x) == "data")
    other = F.filter(line, lambda x: ~sources.line_kind(x).isin("blank", "comment", "marked", "divider"))
    if least > 0:
        rows = rows.where(sources.may_have_data(F.col("text")))
    marked = rows.withColumn("n_data", F.size(data)).withColumn("n_other", F.size(other)).where(F.col("n_data") >= least).where(F.col("n_data") * 100 >= F.col("n_other") * percent)
    numbered = marked.select("source", F.concat_ws(":", "origin", "source", "id").alias("net"), F.posexplode(line).alias("at", "value")).where(sources.line_kind(F.col("value")) == "data")
    return numbered.select("source", "net", (F.col("at") + 1).cast("long").alias("line_no"), "value")


def parsed(found: DataFrame) -> DataFrame:
    """Transitions of the lists; of a list with lines of several lengths those of its most frequent length stay, of equal ones the shorter."""
    width = found.withColumn("nqn", sources.line_nqn(F.col("value")))
    most = width.groupBy("net", "nqn").agg(F.count("*").alias("n")).groupBy("net").agg(F.max_by("nqn", F.struct("n", -F.col("nqn"))).alias("nqn"))
    kept = written(width.join(most, ["net", "nqn"]), "harvest")
    # a line between a level and itself stops the parser; in texts that nobody has checked such lines are passed by
    tok, n = tokens(F.col("value")), F.col("nqn")
    apart = kept.where(F.slice(tok, F.lit(4), n) != F.slice(tok, n + 4, n))
    one = sources.parse_native(apart.select("net", "line_no", "value"))
    by_net = kept.select("net", "source").distinct()
    return sources.kept(one).join(by_net, "net").select("net", "seq", "freq", "unc", "orig_unc", "upper", "lower", "ref", "source")


def run(spark: SparkSession, paths: dict[str, str], out: str, config: dict | None = None) -> dict[str, int]:
    """Writes the three tables under ``out`` and returns how many rows were read and written."""
    attach(spark)
    config = config or load()
    done = {}
    for name, path in paths.items():  # Parquet has its number of rows in its footers
        done[name] = spark.read.parquet(path).count()
        log.info("reading %d rows of %s", done[name], path)
    rows = texts(spark, paths, config)

    def put(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.hint("rebalance", "source").write.mode("overwrite").partitionBy("source").parquet(f"{out}/{name}")
        back = spark.read.schema(schema).parquet(f"{out}/{name}")
        done[name] = back.count()
        log.info("wrote %d rows to %s/%s", done[name], out, name)
        return back

    put(kinds(rows), "profile", PROFILE)
    lines = put(parsed(lists(rows, config["least_data"], config["share_percent"])), "transitions", TRANSITIONS)
    solved = solve.solve_network(lines.drop("source"))
    put(solved.join(lines.select("net", "source").distinct(), "net"), "energies", ENERGIES)
    return done


def profile(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(PROFILE).parquet(f"{out}/profile")


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("out")
    a.add_argument("tables", nargs="+", metavar="NAME=PATH")
    a.add_argument("--config", default=str(CONFIG))
    x = a.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("harvest_lines").getOrCreate()
    try:
        run(spark, dict(v.split("=", 1) for v in x.tables), x.out, load(x.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
