import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from lineweave.session import attach

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return attach(s)


DDL = "net string, seq long, freq double, unc double, orig_unc double, upper string, lower string, ref string"


@pytest.fixture
def net(spark):
    """Rows (freq, unc, upper, lower) as the transitions of one net."""

    def make(rows, name="n"):
        return spark.createDataFrame([(name, i, float(f), float(u), float(u), a, b, "00Test.1") for i, (f, u, a, b) in enumerate(rows)], DDL)

    return make


@pytest.fixture
def ladder():
    """A chain of n levels with one triangle at its foot."""

    def make(n):
        return [(10.0 + i, 1e-3, f"0 {i + 1}", f"0 {i}") for i in range(n - 1)] + [(21.0, 1e-3, "0 2", "0 0")]

    return make
