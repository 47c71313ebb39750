"""Intermediate tables in the folder that driver and executors share, and workers that find this library."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession | None = None) -> None:
    """Lets Python workers import this library where the driver found it by its own path. Without a session, of the active one."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where that is unset, a temporary folder."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return (held or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


_SCRATCH: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end: for a step whose result is written outside of them."""
    _SCRATCH.append(f"scratch-{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        _delete(spark, f"{shared_dir(spark)}/marquee/{spark.sparkContext.applicationId}/{_SCRATCH.pop()}")
        tidy(spark)


def clear_tables(spark: SparkSession) -> None:
    """Removes all tables that this application has written to the shared folder. Results that read them end with them."""
    _delete(spark, f"{shared_dir(spark)}/marquee/{spark.sparkContext.applicationId}")


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage between steps: Spark removes the shuffles and broadcasts of finished ones only then,
    and a driver of many small plans keeps to a small heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marquee/{spark.sparkContext.applicationId}/{_SCRATCH[-1] if _SCRATCH else ''}{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and is read again after an executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
