"""Token ids as ORC files: written in ascending id order, read back by stripe.

Documents are dealt by range of id and sorted within a range, so files and stripes follow the id order and hold disjoint id
ranges.  ORC keeps ids in integer run-length encoding, min/max and row indexes per stripe and per ``STRIDE`` rows, and a Bloom
filter on the document id, so a lookup of some documents skips files, stripes and row groups by metadata alone, and a full read
is split by stripe.

The global offset of a document is the ids of all ranges before (one number per range, known from the files after writing) plus
its offset in its range, which the writer stores with it.

Files: ``doc_id``, ``dealt`` (number of the range), ``at`` (ids before it in its range), ``n_tokens`` and ``ids`` (array of int,
with the end id).

Edge cases: null text has the end id alone; null ids come first; rows with equal ids keep their own rows, ordered by text;
very long texts are encoded whole; an empty table gives a file set without rows; columns of other names are passed by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import scratch_path

STRIPE_BYTES = 16 << 20
STRIDE = 1000
BLOOM_FPP = 0.01
VOCABULARY = "word_bpe_49k.json"
#: Bytes of input that a range of ids stands for, about.
RANGE_BYTES = 32 << 20


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    enc = tokens.of_vocabulary(vocabulary)
    end = np.array([tokens.END_ID], dtype=np.uint32)
    dealt, at = None, 0
    for whole in batches:
        for x in range(0, whole.num_rows, rows):
            part = whole.slice(x, rows)
            ids = enc.encode_column(part.column(1))
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) + 1
            ats = np.zeros(len(ids), dtype=np.int64)
            for i, d in enumerate(part.column(2).to_pylist()):
                if d != dealt:
                    dealt, at = d, 0
                ats[i] = at
                at += int(n[i])
            values = np.concatenate([y for i in ids for y in (i, end)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ats), pa.array(n), lists], names=["doc_id", "dealt", "at", "n_tokens", "ids"])


def n_ranges(docs: DataFrame) -> int:
    """As many ranges as the planner's estimate of the input asks for, the session's number of shuffle partitions at least."""
    estimate = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a source that knows nothing of its size claims the largest number there is
    return max(least, -(-estimate // RANGE_BYTES)) if estimate < 1 << 60 else least


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, ranges: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write ORC files under ``path``.  The texts are shuffled once, by id range."""
    n = ranges or n_ranges(docs.select("doc_id", "text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sorted_ = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").withColumn("dealt", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")
    encoded = sorted_.mapInArrow(lambda batches: _encoded(batches, vocabulary), _file_schema(id_type))
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP).option("orc.create.index", "true")
        .option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", STRIDE).option("compression", "zstd").orc(path)
    )


def _file_schema(id_type: str) -> str:
    return f"doc_id {id_type}, dealt int, at long, n_tokens long, ids array<int>"


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Rows of the files with the global ``start`` of each.  What is broadcast is one pair of numbers per range."""
    rows = spark.read.schema(_file_schema(id_type)).orc(path)
    sizes = rows.groupBy("dealt").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("dealt", (F.sum("n").over(Window.orderBy("dealt")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "dealt").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def crc32_of_ids(rows: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ``ids_crc32``, the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index("ids"))
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_pylist()
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-ids")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
