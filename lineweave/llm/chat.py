"""Chat formatting by Spark expressions only.

A conversation's turns are collected as structs and sorted by turn (ties: role, then text), adjacent turns of one role are merged
by an array aggregation, and the merged turns are concatenated:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

``<|im_sep|>`` stands between the texts of merged turns, so the turns can be read back.  Control strings inside texts and roles
are escaped by one backslash after their first character, one more if there are some already; reading back removes one, so any
text comes back as it was.  Line ends in a role are escaped as well.

A conversation is one value, so it has to fit a row; conversations are spread over tasks by id.

Edge cases: null text and null role are empty; null turns come first; repeated rows are turns of their own; a null ``conv_id`` is
one conversation; an empty table gives no conversations; columns of other names are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of the template and of other common ones.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
#: First character, backslashes so far, rest of a control string.  None of them has its first character again inside.
_STRAY = r"([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _STRAY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _STRAY.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # every backslash of the role was doubled, so what is left between pairs is a line end's
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def merged_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): array of (role, texts) with adjacent turns of one role merged, in order of turn."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # a turn begins a block if its role differs from the one before; blocks are slices between such places
    begins = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"]))
    blocked = sorted_.withColumn("b", begins)
    ends = F.concat(F.slice("b", F.lit(2), F.size("b")), F.array(F.size("t") + 1))
    block = lambda a, z: F.struct(F.element_at("t", a)["role"].alias("role"), F.transform(F.slice("t", a, z - a), lambda x: x["text"]).alias("texts"))
    return blocked.withColumn("e", ends).select("conv_id", F.zip_with("b", "e", block).alias("turns"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row per conversation of ``rows(conv_id, turn, role, text)``."""
    one = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), F.array_join(F.transform(t["texts"], escape), SEP), F.lit(END + "\n"))
    return merged_turns(rows).select("conv_id", F.array_join(F.transform("turns", one), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): array of (role, text) as they were before merging and escaping."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    body = lambda b: F.substr(b, F.lit(len(START) + 1))
    turns = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(_after_line(body(b)), r"<\|im_sep\|>"),
            lambda t: F.struct(_unescape_role(F.substring_index(body(b), "\n", 1)).alias("role"), unescape(t).alias("text")),
        ),
    )
    return formatted.select("conv_id", "formatted", F.flatten(turns).alias("turns"))


def _after_line(s: Column) -> Column:
    return F.substr(s, F.length(F.substring_index(s, "\n", 1)) + 2)


def loss_text(turns: Column) -> Column:
    """What the loss mask covers: each assistant text once, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digests(read: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    with_loss = read.withColumn("loss", loss_text(F.col("turns")))
    return with_loss.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
