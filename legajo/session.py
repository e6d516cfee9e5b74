"""Session helpers that every part of the library may use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def find_package(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies at the same path as on the driver.

    Where it does not (a cluster that ships packages itself) the entry is ignored.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [*known, _ROOT] if x)
    return spark


_SMALL = 32 << 20  # bytes for each core


def spread(df: DataFrame) -> DataFrame:
    """A table's scan with its rows over all cores, where it is a few small files: one of them keeps one core busy.

    Larger tables are left as they are, and no result depends on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * _SMALL and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary one serves a local session (tests); on a
    cluster every executor would write to its own disk, so that raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="legajo-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_folder(spark: SparkSession, name: str = "work") -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/legajo/{name}-{uuid.uuid4().hex}"
