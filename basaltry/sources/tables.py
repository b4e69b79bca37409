"""Tables of an operator's own in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where none is named and Spark runs in one JVM, a temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="basaltry-")
    return _OWN[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the application's folder, which goes when the driver's Python ends."""
    folder = f"{shared_folder(spark)}/basaltry-{spark.sparkContext.applicationId}"
    if folder not in _MADE:
        _MADE.add(folder)
        atexit.register(_forget, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _forget(folder: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None and folder.endswith(context.applicationId):
        with contextlib.suppress(Exception):  # the JVM may have gone before
            remove(SparkSession(context), folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: lineage ends at files that survive the loss of any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Remove a table of written() that no later action reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/basaltry-" in folder:
            remove(df.sparkSession, folder)
