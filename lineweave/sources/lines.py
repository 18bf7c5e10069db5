"""Line lists and level lists as DataFrames.

Text is read by Spark's line reader, so a file is split over tasks.  A line's number comes from two levels: lines before its split,
counted per split, and its place in the split.  Parsers take ``lines(net, line_no, value)`` and are plain expressions, so the rules
run inside code generation and also under a stream (see :mod:`lineweave.streaming`).

White space is what ``\\s`` matches; line ends are ``\\n``, ``\\r\\n`` and ``\\r``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import NUMBER_TOKEN, floored, number, tag, tokens, unit_factor

#: Fixed value: how the line before the data of a machine-readable table begins.
DIVIDER = "-" * 40


def read_lines(spark: SparkSession, path: str | list[str], net: Column | None = None) -> DataFrame:
    """(net, line_no, value): lines of text files, numbered from 1 in each file; ``net`` defaults to the file's name without suffix."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    name = net if net is not None else F.regexp_extract(F.col("file"), r"([^/]*?)(\.[^./]*)?$", 1)
    return raw.withColumn("place", place).join(before, ["file", "block"]).select(name.alias("net"), (F.col("before") + F.col("place")).alias("line_no"), "value")


def _is_data() -> Column:
    return (F.size("tok") >= 5) & ~F.startswith(F.get("tok", F.lit(0)), F.lit("#"))


#: What the native parser makes of a line, in the order in which it is asked.
LINE_KINDS = ("divider", "blank", "comment", "marked", "short", "data", "words")


def text_lines(text: Column) -> Column:
    """Lines of a text; what follows the last line end counts as one."""
    return F.split(text, r"\r\n|\n|\r")


#: Patterns of whole lines, which take no line apart: marked; at least five tokens; three numbers and at least three tokens more; the same of any line of a text, so far as its numbers go.
_MARKED = r"^\s*#"
_FIVE = r"^\s*+(?:\S++\s++){4}\S"
_DATA = rf"^\s*+(?:{NUMBER_TOKEN}\s++){{3}}(?:\S++\s++){{2}}\S"
_SOME_DATA = rf"(?:^|[\r\n])[^\S\r\n]*+(?:{NUMBER_TOKEN}[^\S\r\n]++){{3}}\S"


def may_have_data(text: Column) -> Column:
    """False for texts of which no line is data; one search, before a text is taken apart."""
    return text.rlike(_SOME_DATA)


def line_kind(value: Column) -> Column:
    """One of ``LINE_KINDS``: a divider of a table, no tokens, a comment (``&``), marked by ``#``, fewer than five tokens, data (three
    numbers first, then tokens for two levels and a reference), or other words.

    What is data here passes ``parse_native``, given the number of tokens that ``line_nqn`` tells.
    """
    return (
        F.when(F.startswith(value, F.lit(DIVIDER)), "divider").when(~value.rlike(r"\S"), "blank").when(F.contains(value, F.lit("&")), "comment").when(value.rlike(_MARKED), "marked")
        .when(~value.rlike(_FIVE), "short").when(value.rlike(_DATA), "data").otherwise("words")
    )


def line_nqn(value: Column) -> Column:
    """Tokens of a level in a data line, as the parser infers them."""
    return F.floor((F.size(tokens(value)) - 4) / 2).cast("int")


def _data_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither comments nor too short, as tokens."""
    value = F.col("value")
    return lines.where(~F.contains(value, F.lit("&")) & value.rlike(_FIVE) & ~value.rlike(_MARKED)).withColumn("tok", tokens(value))


def parse_native(lines: DataFrame, nqn: int | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Transitions of native lines: frequency, original and optimised uncertainty, upper and lower tokens, reference.

    Adds ``excluded`` (frequency below zero) to the transition columns; ``seq`` is the line's number.  Without ``nqn`` each net's
    first data line tells how many tokens a level has.  ``segments(tag, unit)`` converts units; a tag that it lacks raises.  A kept
    line between a level and itself raises.
    """
    data = _data_lines(lines)
    if nqn is None:
        first = data.groupBy("net").agg(F.min_by(F.size("tok"), "line_no").alias("n")).select("net", F.floor((F.col("n") - 4) / 2).cast("int").alias("nqn"))
        data = data.join(first, "net")
    else:
        data = data.withColumn("nqn", F.lit(nqn))
    tok, n = F.col("tok"), F.col("nqn")
    # a caller's filter may be evaluated before those here, so what can raise asks itself whether the line is data
    num = lambda i: F.when(_is_data(), number(F.get(tok, F.lit(i))))
    # element_at raises where a line has too few tokens for its reference
    row = data.select(
        "net", F.col("line_no").alias("seq"), num(0).alias("freq"), floored(num(2)).alias("unc"), num(1).alias("orig_unc"),
        F.array_join(F.slice(tok, F.lit(4), n), " ").alias("upper"), F.array_join(F.slice(tok, n + 4, n), " ").alias("lower"), F.when(_is_data(), F.element_at(tok, 2 * n + 4)).alias("ref"),
    )
    if segments is not None:
        row = convert_units(row, segments)
    return checked(row.withColumn("excluded", F.col("freq") < 0.0))


def convert_units(transitions: DataFrame, segments: DataFrame) -> DataFrame:
    """Frequencies and uncertainties in 1/cm by the unit of each line's tag; a tag without a segment raises.

    Segments, a row a tag, are sent to all tasks: by their few tags lines would meet in a few tasks.
    """
    known = segments.select(F.col("tag").alias("_tag"), F.col("unit").alias("_unit"), F.lit(True).alias("_known"))
    joined = transitions.withColumn("_tag", tag(F.col("ref"))).join(F.broadcast(known), "_tag", "left")
    factor = F.when(F.col("_known"), unit_factor(F.col("_unit"))).otherwise(F.raise_error(F.concat(F.lit("missing segment: "), F.col("_tag"))).cast("double"))
    scaled = {c: F.col(c) * F.col("_factor") for c in ("freq", "unc", "orig_unc")}
    return joined.withColumn("_factor", factor).withColumns(scaled).select(*transitions.columns)


def checked(rows: DataFrame) -> DataFrame:
    """Raises on a kept line whose levels are one and the same."""
    message = F.concat(F.lit("upper == lower assignment at line "), F.col("seq").cast("string"), F.lit(": "), F.col("upper"))
    bad = ~F.col("excluded") & (F.col("upper") == F.col("lower"))
    return rows.withColumn("upper", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("upper")))


#: What ``write_checked`` finds wrong with a line.
FAULTS = ("self-loop", "missing segment")


def with_fault(rows: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Adds ``fault``: what keeps a line from being used, or ``none``.  Lines of frequencies below zero are no fault, and not asked for levels."""
    excluded = F.col("excluded") if "excluded" in rows.columns else F.col("freq") < 0.0
    loop = F.coalesce(~excluded & (F.col("upper") == F.col("lower")), F.lit(False))
    if segments is None:
        return rows.withColumn("fault", F.when(loop, FAULTS[0]).otherwise("none"))
    known = segments.select(F.col("tag").alias("_tag"), F.lit(True).alias("_known")).distinct()
    joined = rows.withColumn("_tag", tag(F.col("ref"))).join(F.broadcast(known), "_tag", "left")
    return joined.withColumn("fault", F.when(loop, FAULTS[0]).when(F.col("_known").isNull(), FAULTS[1]).otherwise("none")).select(*rows.columns, "fault")


def write_checked(rows: DataFrame, path: str, segments: DataFrame | None = None, *, fail: bool = True, shown: int = 10) -> DataFrame:
    """Writes all lines to ``path``, partitioned by ``fault``, in one pass, and returns (fault, n).

    Where ``checked`` and ``convert_units`` stop at the first bad line, this finishes and then raises, if ``fail``, with the number of bad lines of
    each kind and the first ``shown`` of them; all are at ``path`` for a look, and the good ones under ``fault=none``.
    """
    marked = with_fault(rows, segments)
    marked.write.mode("overwrite").partitionBy("fault").parquet(path)
    back = rows.sparkSession.read.schema(marked.schema).parquet(path)
    counts = back.groupBy("fault").agg(F.count("*").alias("n"))
    bad = {r["fault"]: r["n"] for r in counts.where("fault <> 'none'").collect()}  # one row a kind
    if bad and fail:
        first = back.where("fault <> 'none'").orderBy("net", "seq").limit(shown).collect()
        told = "; ".join(f"{r['net']} line {r['seq']}: {r['fault']} ({r['upper']} - {r['lower']}, {r['ref']})" for r in first)
        raise ValueError(f"{', '.join(f'{n} of {k}' for k, n in sorted(bad.items()))}: {told}")
    return counts


def parse_native_levels(lines: DataFrame) -> DataFrame:
    """Levels: all but the last three tokens are the key, then energy, uncertainty, count; of equal keys the last line stays."""
    tok = F.col("tok")
    data = lines.withColumn("tok", tokens(F.col("value"))).where((F.size("tok") >= 4) & ~F.startswith(F.get(tok, F.lit(0)), F.lit("#")))
    rows = data.select(
        "net", "line_no", F.array_join(F.slice(tok, F.lit(1), F.size(tok) - 3), " ").alias("level"), number(F.element_at(tok, -3)).alias("energy"),
        number(F.element_at(tok, -2)).alias("unc"), F.element_at(tok, -1).cast("int").alias("n_trans"),
    )
    return _last(rows)


def _last(rows: DataFrame) -> DataFrame:
    kept = F.max_by(F.struct("energy", "unc", "n_trans"), "line_no").alias("v")
    return rows.groupBy("net", "level").agg(kept).select("net", "level", "v.energy", "v.unc", "v.n_trans")


def mrt_data(lines: DataFrame) -> DataFrame:
    """Non-blank lines after the last divider of each list, as tokens; a list without a divider raises."""
    last = lines.groupBy("net").agg(F.max(F.when(F.startswith(F.col("value"), F.lit(DIVIDER)), F.col("line_no"))).alias("last"))
    joined = lines.withColumnRenamed("net", "list").join(last.withColumnRenamed("net", "list"), "list")
    checked_ = joined.withColumn("last", F.when(F.col("last").isNull(), F.raise_error(F.concat(F.lit("no divider in "), F.col("list"))).cast("long")).otherwise(F.col("last")))
    return checked_.where("line_no > last").withColumn("tok", tokens(F.col("value"))).where(F.size("tok") > 0)


def _mrt_token(i: int) -> Column:
    """Token of a data line; a line that is too short raises.  By way of ``last`` no filter on it goes below the divider's join."""
    return F.when(F.col("line_no") > F.col("last"), F.element_at("tok", i + 1))


def parse_mrt_transitions(lines: DataFrame) -> DataFrame:
    """Transitions of a machine-readable table: network, name (ignored), frequency, uncertainty, two tokens each level, reference."""
    tok = _mrt_token
    unc = floored(number(tok(3)))
    pair = lambda i: F.concat_ws(" ", tok(i), tok(i + 1))
    return mrt_data(lines).select(
        tok(0).alias("net"), F.col("line_no").alias("seq"), number(tok(2)).alias("freq"), unc.alias("unc"), unc.alias("orig_unc"), pair(4).alias("upper"), pair(6).alias("lower"),
        tok(8).alias("ref"), (number(tok(2)) < 0.0).alias("excluded"),
    )


def parse_mrt_levels(lines: DataFrame) -> DataFrame:
    """Levels of a machine-readable table: network, name (ignored), two tokens, energy, uncertainty, count."""
    tok = _mrt_token
    rows = mrt_data(lines).select(
        tok(0).alias("net"), "line_no", F.concat_ws(" ", tok(2), tok(3)).alias("level"), number(tok(4)).alias("energy"), number(tok(5)).alias("unc"), tok(6).cast("int").alias("n_trans")
    )
    return _last(rows)


def kept(transitions: DataFrame) -> DataFrame:
    return transitions.where(~F.col("excluded")).drop("excluded")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file per net under ``path``, lines in order."""
    lines.repartition("net").sortWithinPartitions("net", "line_no").select("net", "value").write.partitionBy("net").text(path)
