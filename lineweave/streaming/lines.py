"""Lines that arrive as a stream: parsing is stateless, solving is done per micro-batch over the nets that were touched.

The number of tokens of a level has to be given, as there is no first line of a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.solve import solve_energies
from ..sources.lines import kept, parse_native


#: Parts of the store.
PARTS = 256


def read_stream(spark: SparkSession, path: str, *, nqn: int) -> DataFrame:
    """Transitions of text files ``path`` gets; columns ``net`` and ``line_no`` come with each line, separated by tabs."""
    parts = F.split(F.col("value"), "\t", 3)
    raw = spark.readStream.text(path).select(parts[0].alias("net"), parts[1].cast("long").alias("line_no"), parts[2].alias("value"))
    return parse_native(raw, nqn=nqn)


def solve_touched(transitions: DataFrame, store: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Appends each batch to the Parquet table ``store``, partitioned by a hash of the net, and solves the nets of the batch anew.

    Only the parts of the store that the batch's nets are in are read.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        # a batch that is run again after a failure replaces its own files
        part = F.pmod(F.xxhash64("net"), F.lit(PARTS)).cast("int")
        kept(df).withColumn("part", part).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(store)
        lines = spark.read.parquet(store)
        touched = lines.where(F.col("batch") == number).select("part", "net").distinct()
        parts = [r["part"] for r in touched.select("part").distinct().collect()]  # PARTS numbers at most
        mine = lines.where(F.col("part").isin(parts))
        sink(solve_energies(mine.join(touched.select("net"), "net", "left_semi").drop("part", "batch")), number)

    return transitions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
