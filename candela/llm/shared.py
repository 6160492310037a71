"""The shared folder for written tables and checkpoints, and input normalisation."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, str] = {}
#: The identifier that stands for a null doc_id, so that it comes last.
LAST = (1 << 63) - 1
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that the context was given; an own temporary one only in local mode, as in tests."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or _made.get(context.applicationId) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = _made[context.applicationId] = tempfile.mkdtemp(prefix="candela-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def identifier(docs: DataFrame, name: str = "doc_id") -> Column:
    """The integer identifier column as bigint, LAST for null (so LAST itself counts as null). Another type is refused, since its order isn't that of numbers."""
    kind = docs.select(docs[name].alias("x")).dtypes[0][1]
    if kind not in _WHOLE and kind != "void":
        raise TypeError(f"{name} must be an integer column, not {kind}")
    return F.coalesce(docs[name].cast("bigint"), F.lit(LAST))


def in_order(row: Column | str) -> Column:
    """A string that orders rows of any type, maps included; equal for equal rows."""
    return F.to_json(F.struct(row))


def file_system(path: str):
    """The pyarrow file system of a path or URI, and the path in it; for tasks, which have no session."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def selector(path: str):
    """What pyarrow lists the files of a folder by."""
    from pyarrow import fs

    return fs.FileSelector(path)


def address(folder: str, path: str) -> str:
    """The URI of a path that file_system(folder) gave, for Spark."""
    return f"file://{path}" if folder.startswith("file:") or "://" not in folder else f"{folder.split('://')[0]}://{path}"


def shipped(spark: SparkSession, path: str):
    """A function that gives, in a task, the local path of a copy of the file, which the driver sends to the executors."""
    spark.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]

    def there() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return there


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            pass

    atexit.register(clean)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows, with their lineage cut by a checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apply_rows(df: DataFrame, inputs: dict[str, Column], function, schema: str) -> DataFrame:
    """mapInArrow of function over just the named inputs, so that other columns of df, whatever their names, stay out."""
    return df.select(*[c.alias(n) for n, c in inputs.items()]).mapInArrow(function, schema)


def own_column(df: DataFrame, name: str) -> Column:
    """Column of df; null where df has none of that name (case is ignored, as in Spark)."""
    return df[name] if name.lower() in [c.lower() for c in df.columns] else F.lit(None)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again; cuts the lineage and lets later reads prune columns."""
    spark = df.sparkSession
    at = scratch(spark, name)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
