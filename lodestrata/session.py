"""Making the package importable in Python workers, and tables that a job writes for itself."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they see it already by their path or working folder."""
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(p and Path(p).resolve() == ROOT for p in seen) or getattr(context, "_lodestrata_shipped", False):
        return
    base, package = Path(tempfile.mkdtemp(prefix="lodestrata-ship-")), __name__.split(".")[0]
    shutil.copytree(ROOT / package, base / "stage" / package, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(base / package), "zip", base / "stage"))
    context._lodestrata_shipped = True


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that the cluster shares, from ``spark.checkpoint.dir``; one of our own only in local mode without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return f"{root}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: several readers don't compute it again, and no lost executor makes them see other rows."""
    path = shared_path(df.sparkSession, "written")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt into as many partitions as a shuffle has: little data with much work a row is otherwise one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
