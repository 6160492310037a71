"""Cutting lineage in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The named folder, or the one that the context was given; an own temporary one only in local mode, as in tests."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _own.get(context.applicationId)
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = _own[context.applicationId] = tempfile.mkdtemp(prefix="candela-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path below the folder, removed when the application ends."""
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            pass

    atexit.register(clean)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, so a lost executor costs no more than the step after it.

    The driver collects its garbage then: until it does, the shuffle files of what is written stay on disk, and its plan in memory.
    """
    at = path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(at)
