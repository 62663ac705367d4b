"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The word separators of every contract here, as regular expression and as characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

_own: list[tempfile.TemporaryDirectory] = []


#: Rows of an Arrow batch of texts, where the session doesn't set its own, and bytes of a row group of written tables.
BATCH_ROWS, ROW_GROUP = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder takes its place, if driver and executors are one process; else this raises, as
    executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="symloom-"))
        atexit.register(_own[0].cleanup)
    return _own[0].name


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this process under ``key`` for the tasks to come.

    Functions reach workers by value, each with globals of its own, so what they share is in a module made here.
    """
    own = sys.modules.setdefault("_symloom_worker", types.ModuleType("_symloom_worker")).__dict__
    if key not in own:
        own[key] = make()
    return own[key]


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small in this session, unless it sets their size itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The JVM deletes the folder when it ends. Parquet measures a row group and a page from the hundredth row on, so those of rows
    with megabytes would grow with the partition, and a task holds one of each: such tables say by ``group_rows`` how many rows
    a row group has at most, and their pages are measured from the first row on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    bounds = {"parquet.block.row.count.limit": group_rows, "parquet.page.size.row.check.min": 1} if group_rows else {}
    df.write.options(**{"parquet.block.size": ROW_GROUP} | bounds).parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffles and broadcasts that nothing refers to any more.

    The cleaner follows the driver's garbage collection, which comes late where a loop makes many small tables.
    """
    spark._jvm.System.gc()


def buckets_for(rows: int, per_bucket: int = 4096) -> int:
    """How many buckets keep a bucket near ``per_bucket`` rows."""
    return max(16, min(1_000_000, -(-rows // per_bucket)))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of ``keys`` that holds for nulls too."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, Column], buckets: int) -> DataFrame:
    """Adds, for each ``name: value`` of ``sums``, the sum of ``value`` over the rows before this one in its group.

    A group's rows are dealt to ``buckets`` by a hash of ``order``, so that no task has to hold a large
    group; buckets follow each other, and rows in a bucket follow ``order``. ``df`` is read twice and should
    be a cheap plan over a written table. Rows that tie in ``order`` may change places.
    """
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = keyed.groupBy(*groups, "_bucket").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    over = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_t_{n}") for n in sums])
    totals = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], F.col("_bucket").alias("_b"), *[f"_t_{n}" for n in sums])
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{n}") for n, v in sums.items()])
    cond = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(groups):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = ranked.join(totals, cond)
    return joined.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums])
