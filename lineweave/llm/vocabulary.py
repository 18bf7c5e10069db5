"""Words counted over a corpus, and the bounded part of them that tasks may hold in memory."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct words that a task counts before it hands them on.
HELD = 1 << 19
#: Steps of the histogram of counts in each power of two: its rows are bounded whatever the vocabulary.
STEPS = 32


def partial_counts(rows: DataFrame, words, schema: str) -> DataFrame:
    """(group, word, n) not yet summed up: each task counts what ``words(batch)`` yields, pairs of a group and its words."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        counts: dict[object, Counter] = {}
        for b in batches:
            for group, found in words(b):
                counts.setdefault(group, Counter()).update(found)
            if sum(map(len, counts.values())) >= HELD:
                yield from packed(counts)
                counts = {}
        yield from packed(counts)

    def packed(counts):
        for group, c in counts.items():
            names, ns = list(c), list(c.values())
            for at in range(0, len(names), 1 << 16):
                part = names[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(part), out[0].type), pa.array(part, out[1].type), pa.array(ns[at : at + (1 << 16)], out[2].type)], schema=out)

    return rows.mapInArrow(run, schema)


def _step(n: Column) -> Column:
    return F.floor(F.log2(n) * STEPS).cast("int")


def frequent_bound(counts: DataFrame, limit: int) -> int:
    """The least step of ``counts(n)`` such that at most ``limit`` rows reach it."""
    kept, bound = 0, 64 * STEPS
    for step, n in sorted(((r[0], r[1]) for r in counts.groupBy(_step(F.col("n"))).count().collect()), reverse=True):
        kept += n
        if kept > limit:
            break
        bound = step
    return bound


def reaches(n: Column, bound: int) -> Column:
    return _step(n) >= bound
