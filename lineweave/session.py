"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches that go to Python workers hold at most so many bytes, unless the session says otherwise: several copies of one
#: live at a time, in the JVM and in the worker.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

#: Whether Spark removes the shuffle files of an execution when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_attached: set[str] = set()
_own: dict[str, str] = {}


def attach(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors' Python workers, once per application, and bound their Arrow batches."""
    sc = spark.sparkContext
    if spark.conf.get(ARROW_BYTES[0], None) is None:
        spark.conf.set(*ARROW_BYTES)
    if sc.applicationId not in _attached:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(target)
        atexit.register(shutil.rmtree, os.path.dirname(target), ignore_errors=True)
        _attached.add(sc.applicationId)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, it is a folder of this process, gone when it ends.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lineweave-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing asks for the shuffle files of what is written, so they go at once instead of when the driver happens to collect its garbage; tables stay, and are
    written small.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
