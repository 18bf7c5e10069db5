"""What the operators of this subpackage share: scratch tables, whole-text access and word patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, written  # noqa: F401

#: Fixed value: the word pattern of the query contracts (ASCII white space separates, nothing else does).
WORD = r"[^\x20\x09-\x0D]+"
#: The same separators as bytes, for ``bytes.translate``; ``bytes.split()`` splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(value: Column) -> Column:
    """A string that stands for ``value``, null included, so that joins and groups need no null-safe comparison."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def arrow_map(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[tuple]], schema: T.StructType, batch: int = 512) -> DataFrame:
    """``mapInArrow`` over rows: ``rows`` gets an iterator of column-dict batches and yields output tuples.

    ``rows`` sees ``{column: list}`` for every Arrow batch of one partition in turn and may keep state over the
    partition.  Output leaves in batches of ``batch`` rows, so memory follows the batch, not the partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)

    def run(batches):
        def dicts():
            for b in batches:
                # slices keep few whole texts in Python at a time
                for at in range(0, b.num_rows, batch):
                    yield b.slice(at, batch).to_pydict()

        held: list[tuple] = []
        for row in rows(dicts()):
            held.append(row)
            if len(held) >= batch:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(held):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), out_schema)], schema=out_schema)

    return df.mapInArrow(run, schema)
