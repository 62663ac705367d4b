"""Tables in the folder that driver and executors share, which cut long plans and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Stored tables of more rows are met by merging: a small file of repeated values may stand for more memory than a broadcast has.
MERGED_ROWS = 50_000

_own: list[tempfile.TemporaryDirectory] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder if the driver is the only executor."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="symloom-"))
        atexit.register(_own[0].cleanup)
    return _own[0].name


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, deleted when the driver's JVM ends; one of many rows is never broadcast."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if out.count() > MERGED_ROWS else out


def drop(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more; Spark's cleaner removes the shuffles that it was made by."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    spark._jvm.System.gc()  # the cleaner follows the driver's garbage collection
