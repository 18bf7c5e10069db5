"""Test tables seen as transition networks.

T: one network per ship month; levels are parts ("1 <key>") and suppliers ("0 <key>"), lines are line items.  ``consistent`` replaces the
frequency by a difference of potentials (retail price + 20000 for a part, account balance for a supplier), so any solve must return
potentials minus the least of the component.  Uncertainties are discount + 0.01 and tax + 0.01, or as they are (``raw``), zeros included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART_SHIFT = 20000.0


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transitions(spark: SparkSession, sf_dir: str, *, raw: bool = False) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").withColumn("net", F.date_format("l_shipdate", "yyyy-MM"))
    place = F.row_number().over(Window.partitionBy("net").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    shift = 0.0 if raw else 0.01
    return rows.select(
        "net", place.cast("long").alias("seq"), F.col("l_extendedprice").alias("freq"), (F.col("l_discount") + shift).alias("unc"), (F.col("l_tax") + shift).alias("orig_unc"),
        F.concat(F.lit("1 "), F.col("l_partkey")).alias("upper"), F.concat(F.lit("0 "), F.col("l_suppkey")).alias("lower"), F.concat("l_returnflag", "l_linestatus", F.lit("."), "l_linenumber").alias("ref"),
    )


def potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, potential).

    Joins with them are hinted to shuffle: they grow with the tables, but their pruned files look small enough to be sent whole to every executor.
    """
    part = _read(spark, sf_dir, "part").select(F.concat(F.lit("1 "), F.col("p_partkey")).alias("level"), (F.col("p_retailprice") + PART_SHIFT).alias("potential"))
    return part.unionByName(_read(spark, sf_dir, "supplier").select(F.concat(F.lit("0 "), F.col("s_suppkey")).alias("level"), F.col("s_acctbal").alias("potential")))


def consistent(spark: SparkSession, sf_dir: str, *, raw: bool = False, of: DataFrame | None = None) -> DataFrame:
    """T with differences of potentials for frequencies; ``of`` has T where it is written already."""
    p = potentials(spark, sf_dir)
    lines = (transitions(spark, sf_dir, raw=raw) if of is None else of).drop("freq")
    up, low = (p.select(F.col("level").alias(end), F.col("potential").alias(v)).hint("shuffle_hash") for end, v in (("upper", "_u"), ("lower", "_l")))
    both = lines.join(up, "upper").join(low, "lower")
    return both.select("net", "seq", (F.col("_u") - F.col("_l")).alias("freq"), "unc", "orig_unc", "upper", "lower", "ref")


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(net, level, energy): the potential of every level of every net."""
    lines = transitions(spark, sf_dir)
    levels = lines.select("net", F.explode(F.array("upper", "lower")).alias("level")).distinct()
    return levels.join(potentials(spark, sf_dir).withColumnRenamed("potential", "energy").hint("shuffle_hash"), "level").select("net", "level", "energy")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def native_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(net, line_no, value): T as native lines with comments, short lines, blank lines and frequencies below zero among them."""
    t = transitions(spark, sf_dir, raw=True)
    line = F.concat_ws(" ", _money("freq"), _money("orig_unc"), _money("unc"), "upper", "lower", "ref")
    k = F.col("seq") % 20
    value = F.when(k == 3, F.concat(line, F.lit(" & note"))).when(k == 5, F.concat(F.lit("# "), line)).when(k == 7, F.lit("1.0 2.0 3.0 x")).when(k == 9, F.lit("  ")).when(k == 11, F.concat(F.lit("\t-"), line)).otherwise(line)
    return t.select("net", F.col("seq").alias("line_no"), value.alias("value"))


def long_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level): seven-token levels of the parts."""
    size = F.col("p_size")
    letter = F.when(F.col("p_partkey") % 2 == 0, "e").otherwise("f")
    return _read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_partkey", size, F.lit(0), F.lit(0), F.lit(0), F.lit(1), letter).alias("level"))
