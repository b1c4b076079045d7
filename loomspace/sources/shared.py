"""The folder that driver and executors share: intermediate tables that outlive executors, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder if all of Spark runs on this machine (tests), else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomspace-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes files or folders; what is not there is skipped."""
    for path in paths:
        files, at = _at(spark, path)
        files.delete(at, True)


#: Paths that written() made in each scratch() that is open, the innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the intermediate tables that operators wrote within it. A result has to be stored or collected inside, as it may read them."""
    _open.append([])
    try:
        yield
    finally:
        remove(spark, *_open.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once and outlives executors. It stays there until the scratch() around the call ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a table may have to be broadcast after it was counted.
FEW = 20_000


def counted(df: DataFrame, name: str, most: int = FEW) -> DataFrame:
    """df, written and counted; if its rows are few it is marked for broadcast, so that what it meets is not dealt out by a few skewed keys, whichever side is ready first."""
    made = written(df, name)
    return F.broadcast(made) if made.count() <= most else made
