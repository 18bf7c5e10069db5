"""Scalar derivations on levels, references and uncertainties."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed of light in cm/s and the units that a frequency may be given in, in Hz.
LIGHT_CM_S = 2.99792458e10
HZ = {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9, "THz": 1e12}
#: Uncertainty that stands for exactly zero, in 1/cm.
UNC_FLOOR = 1e-6
#: Slots for quantum numbers, and what letters count as.
QN_SLOTS = 7
PARITY = {"e": 0.0, "f": 1.0}
#: Units of refit errors and widths per 1/cm.
ERROR_SCALE = 1e6


def tokens(line: Column) -> Column:
    """Tokens between white space; none for a blank line."""
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def tag(ref: Column) -> Column:
    """Source tag: the reference up to its first dot."""
    return F.substring_index(ref, ".", 1)


def floored(unc: Column) -> Column:
    return F.when(unc == 0.0, F.lit(UNC_FLOOR)).otherwise(unc)


def unit_factor(unit: Column) -> Column:
    """Factor from a unit to 1/cm; 1 for others."""
    expr = F.lit(1.0)
    for name, hz in HZ.items():
        expr = F.when(unit == name, F.lit(hz / LIGHT_CM_S)).otherwise(expr)
    return expr


def weight(unc: Column) -> Column:
    return F.lit(1.0) / (unc * unc)


#: A number of the file format, as a whole and before white space.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i)(nan|inf|infinity)$"
NUMBER_TOKEN = r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))"


def number(token: Column) -> Column:
    """A token as a double, null for none; bad ones raise.  Only what is a number in the file format passes the cast."""
    ok = token.rlike(NUMBER)
    return F.when(ok, token.cast("double")).when(token.isNotNull(), F.raise_error(F.concat(F.lit("not a number: "), token)).cast("double"))


def qn_vector(level: Column) -> Column:
    """Quantum numbers as ``QN_SLOTS`` doubles, padded by zeros; letters other than the parities raise."""
    toks = F.split(level, " ")
    value = lambda t: F.coalesce(F.element_at(F.create_map(*[x for k, v in PARITY.items() for x in (F.lit(k), F.lit(v))]), t), F.when(~t.isin(*PARITY), t.cast("double")))
    padded = F.concat(F.transform(toks, value), F.array_repeat(F.lit(0.0), F.greatest(F.lit(QN_SLOTS) - F.size(toks), F.lit(0))))
    return F.when(F.size(toks) <= QN_SLOTS, padded).otherwise(F.raise_error(F.concat(F.lit("too many tokens: "), level)).cast("array<double>"))


def shifted(level: Column, position: int, by: Column) -> Column:
    """The level with the integer token at ``position`` (from 0) changed by ``by``; null if the level has no such token."""
    toks = F.split(level, " ")
    j = F.try_element_at(toks, F.lit(position + 1)).cast("int")
    moved = F.concat(F.slice(toks, F.lit(1), F.lit(position)), F.array((j + by).cast("string")), F.slice(toks, F.lit(position + 2), F.greatest(F.size(toks) - position - 1, F.lit(0))))
    return F.when(F.size(toks) > position, F.array_join(moved, " "))


def token_int(level: Column, position: int) -> Column:
    return F.try_element_at(F.split(level, " "), F.lit(position + 1)).cast("int")


def hashed(*parts: Column | str | int) -> Column:
    """A 32-bit number from the MD5 of the parts joined by bars; the same in any engine and under any partitioning."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hashes(seqs, *parts) -> list[int]:
    """What ``hashed(*parts, seq)`` is for each of ``seqs``, for use inside a task."""
    start = hashlib.md5("".join(f"{p}|" for p in parts).encode())
    out = []
    for seq in seqs:
        h = start.copy()
        h.update(str(seq).encode())
        out.append(int(h.hexdigest()[:8], 16))
    return out


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1) from ``hashed``."""
    return hashed(*parts) / F.lit(4294967296.0)


def copy_key(net: Column | str, *numbers: Column | str) -> Column:
    """A net's name with numbers after it, each behind a ``#``; the name may have any characters."""
    return F.concat_ws("#", net, *numbers)


def copy_parts(key: Column, count: int) -> tuple[Column, ...]:
    """The name and the ``count`` numbers of a ``copy_key``, read from its end."""
    pattern = r"(?s)^(.*)" + r"#(-?[0-9]+)" * count + "$"
    return F.regexp_extract(key, pattern, 1), *(F.regexp_extract(key, pattern, i + 2).cast("int") for i in range(count))
