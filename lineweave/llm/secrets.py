"""Secret scans: fixed rules and sliding-window Shannon entropy over candidate strings of each whole text.

Base kinds (contract): ``assign``, ``access`` and ``hex``; each is found leftmost and non-overlapping, then matches that are
too short are dropped.  The method adds kind ``entropy``: maximal runs of ``[A-Za-z0-9+/=_-]`` of at least ``WINDOW`` characters
are candidates.  A window slides over a candidate; per class of characters (hex digits, alphanumeric, base64) the counts of the
window's characters change by one entry and one exit a step, and the sum of n*log2(n) with them, so a step costs the same
whatever the window.  Windows whose characters all belong to the class and whose entropy reaches the class's bound are merged
into spans.  A span counts unless every part between separators that it touches is harmless: a word or joined words, a number, a
word with a short number, a part of a UUID, or what a placeholder leaves of a part.  So a harmless part hides nothing beside it.
A span that lies within a base span is not repeated.

Edge cases: null or empty text has no spans; very long texts are scanned whole, in one pass per rule; repeated rows give the same
rows again; an empty table gives no rows; columns of other names are passed by.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Words that announce a secret.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(map(_either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # greedy, so a match is a whole run
#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "entropy")
#: Every match of ASSIGN holds one of these in lower case.
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % WINDOW)
#: Class: (members, bits of entropy from which a window counts).  A window of 20 random characters has 3.4 bits in
#: hexadecimal and 4.1 in base64 on average; sixteen and sixty-four symbols allow 4.0 and 4.3.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 3.0),
    "alnum": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.7),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 3.9),
}
PART = re.compile(r"[A-Za-z0-9]+")
HARMLESS = re.compile(r"[0-9]+\Z|[A-Z]?[a-z]+[0-9]{1,4}\Z")  # numbers, names with short numbers
#: Words joined by capitals; no lower-case letter between two capitals stands alone.
WORDS = re.compile(r"(?:[a-z](?=[A-Z]))?(?:[A-Z]*+[a-z]{2,}+)*+[A-Z]*+[a-z]?\Z")
#: Bits of a window from which letters alone are no words.
WORD_BITS = 3.9
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![A-Za-z0-9])")
PLACEHOLDER = re.compile(r"(?i:example|placeholder|changeme|x{4,}|0{10,}|1234567890)|abcdefghij|ABCDEFGHIJ")

_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def window_spans(s: str, members: frozenset, bits: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``s`` made of ``members`` alone whose entropy is at least ``bits``."""
    counts: dict[str, int] = {}
    load, outside, spans = 0.0, 0, []
    table = _NLOGN if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    most = math.log2(window)
    for i, c in enumerate(s):
        if i >= window:
            old = s[i - window]
            n = counts[old]
            counts[old] = n - 1
            load += table[n - 1] - table[n]
            outside -= old not in members
        n = counts.get(c, 0)
        counts[c] = n + 1
        load += table[n + 1] - table[n]
        outside += c not in members
        if i >= window - 1 and not outside and most - load / window >= bits - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [(a, b) for a, b in spans]


def harmless(part: str) -> bool:
    """``part`` is of letters and digits."""
    if HARMLESS.match(part):
        return True
    return bool(WORDS.match(part)) and not (len(part) >= WINDOW and window_spans(part, CLASSES["alnum"][0], WORD_BITS))


def suspects(candidate: str) -> list[tuple[int, int]]:
    """Places of the parts of a candidate that are not harmless."""
    blank = lambda m: "-" * len(m.group())
    return [m.span() for m in PART.finditer(PLACEHOLDER.sub(blank, UUID.sub(blank, candidate))) if not harmless(m.group())]


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, in code points, by start and kind."""
    if not text:
        return []
    found = []
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if any(h in lower for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def entropy_spans(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(entropy, start, end) of what the base spans do not hold already."""
    found = []
    starts = [x for _, x, _ in base]
    reach = list(accumulate((y for _, _, y in base), max))  # how far the base spans up to one reach
    for m in CANDIDATE.finditer(text or ""):
        s, at = m.group(), m.start()
        if not (odd := suspects(s)):
            continue
        ends = [y for _, y in odd]  # parts lie one behind the other
        merged: list[list[int]] = []
        for a, b in sorted(x for members, bits in CLASSES.values() for x in window_spans(s, members, bits)):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            part, before = bisect_right(ends, a), bisect_right(starts, at + a)
            if part < len(odd) and odd[part][0] < b and not (before and reach[before - 1] >= at + b):
                found.append(("entropy", at + a, at + b))
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str | None) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base), key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end) of each row of ``docs``; no shuffle."""
    span = T.ArrayType(T.StructType.fromDDL("kind string, start long, end long"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("base", span), T.StructField("spans", span)])

    def rows(batches):
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for b in batches:
            for i, t in zip(b["id"], b["text"]):
                base, spans = all_spans(t)
                yield i, named(base), named(spans)

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, schema)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    if not text:
        return text
    out, at = [], 0
    for _, a, b in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars``, if there, counted anew; no row goes, other columns stay."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                i = names.index("text")
                b = b.set_column(i, b.schema.field(i), pa.array([redact(t, mark) for t in b.column(i).to_pylist()], type=b.schema.field(i).type))
                yield b

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest and list that the query returns, from the operator's spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("id").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
