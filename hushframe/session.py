"""Sessions: building one for local use, and sending this package to a cluster's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session of one JVM for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hushframe")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, once for a session; nothing to do where PYTHONPATH has it."""
    sc = spark.sparkContext
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_hushframe_sent", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="hushframe-"), "hushframe_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(ROOT.rglob("*")):
            if file.suffix in (".py", ".yaml", ".json"):
                out.write(file, file.relative_to(ROOT.parent))
    sc.addPyFile(path)
    sc._hushframe_sent = True
    return spark
