"""Jobs from lists of lines to energies, with and without units given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network, solve, units
from ..session import attach, written
from ..sources import lines


def invert(transitions: DataFrame, *, minsize: int = 2, bootstrap_iterations: int = 0, seed: int = 0) -> DataFrame:
    """(net, comp, level, energy, unc) of all components of at least ``minsize`` levels."""
    solvable, _ = network.split_components(transitions, minsize=minsize)
    return solve.solve_network(solvable.select(*transitions.columns), bootstrap_iterations=bootstrap_iterations, seed=seed)


def from_native_files(spark: SparkSession, path: str, *, nqn: int | None = None, segments: DataFrame | None = None, minsize: int = 2, bootstrap_iterations: int = 0, seed: int = 0) -> DataFrame:
    """Native files to energies and uncertainties."""
    parsed = lines.parse_native(lines.read_lines(attach(spark), path), nqn=nqn, segments=segments)
    return invert(lines.kept(parsed), minsize=minsize, bootstrap_iterations=bootstrap_iterations, seed=seed)


def infer_segments(spark: SparkSession, path: str, levels: DataFrame, *, nqn: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, report): unit of each tag and the counts behind it, to be looked at before a solve relies on them."""
    parsed = lines.parse_native(lines.read_lines(attach(spark), path), nqn=nqn)
    report = written(units.unit_report(parsed, levels), "report")
    return units.infer_units(report), report


def from_unlabelled_files(spark: SparkSession, path: str, levels_path: str, *, nqn: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(energies, segments, report): units are inferred from the levels, lines converted, networks solved.

    Files are parsed once; inferred units, a row for each net and tag, join back.
    """
    raw = written(lines.parse_native(lines.read_lines(attach(spark), path), nqn=nqn), "raw")
    levels = lines.parse_native_levels(lines.read_lines(spark, levels_path))
    report = written(units.unit_report(raw, levels), "report")
    segments = units.infer_units(report)
    from ..functions.scalars import tag, unit_factor

    keyed = raw.withColumn("tag", tag(F.col("ref"))).join(segments, ["net", "tag"]).withColumn("factor", unit_factor(F.col("unit")))
    converted = keyed.select("net", "seq", *[(F.col(c) * F.col("factor")).alias(c) for c in ("freq", "unc", "orig_unc")], "upper", "lower", "ref", "excluded")
    return invert(lines.kept(lines.checked(converted))), segments, report
