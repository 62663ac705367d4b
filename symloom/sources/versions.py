"""Tables in versions: parts are written beside each other, and one file says which parts a version is made of.

A table is dealt to buckets by a hash of its key. A change writes new parts for the buckets it touches and then the file of
the next version, which appears at once by a rename. Until then readers see the version before; a change that breaks off
leaves parts that no version names. Two changes from the same version can't both be made: the second one raises.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import folder

#: Buckets of a table, unless it says otherwise.
BUCKETS = 32


def scratch(spark: SparkSession, label: str) -> Versions:
    """Versions in a folder of their own in the shared one, deleted when the driver's JVM ends."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return Versions(spark, path)


class Versions:
    """The versions under a folder. ``at`` is the number of the version that this object reads, 0 if there is none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.refresh()

    def refresh(self) -> Versions:
        """Reads the newest version from now on."""
        fs, folder = self._fs(f"{self.path}/versions")
        found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        self.at = max((int(n.removesuffix(".json")) for n in found if n.endswith(".json")), default=0)
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/versions/{self.at}.json").collect()) if self.at else "{}"  # one file of parts
        self.tables: dict[str, dict] = json.loads(text)
        return self

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def bucket(self, table: str, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.tables[table]["buckets"])).cast("int")

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets alone."""
        about = self.tables[table]
        parts = sorted({p for b, p in about["parts"].items() if buckets is None or int(b) in set(buckets)})
        if not parts:
            return self.spark.createDataFrame([], about["schema"])
        return self.spark.read.schema(about["schema"]).parquet(*parts)

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets of the keys in the one column of ``keys``."""
        return sorted(r["b"] for r in keys.select(self.bucket(table, F.col(keys.columns[0])).alias("b")).distinct().collect())

    def put(self, table: str, df: DataFrame, key: str, buckets: int = BUCKETS, sort: list[str] = ()) -> None:
        """Writes a whole table, for the next version."""
        self.tables = self.tables | {table: {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "key": key, "buckets": buckets, "sort": list(sort), "parts": {}}}
        self._write(table, df, list(range(buckets)))

    def rewrite(self, table: str, df: DataFrame, touched: list[int]) -> None:
        """Writes what the ``touched`` buckets hold from the next version on; others keep their parts."""
        if touched:
            self._write(table, df.select(*[f.name for f in self.read(table).schema.fields]), touched)

    def _write(self, table: str, df: DataFrame, touched: list[int]) -> None:
        about = self.tables[table]
        folder = f"{self.path}/{table}/{uuid.uuid4().hex}"
        dealt = df.withColumn("_bucket", self.bucket(table, F.col(about["key"])))
        dealt.repartition("_bucket").sortWithinPartitions("_bucket", *about["sort"]).write.partitionBy("_bucket").parquet(folder)
        fs, where = self._fs(folder)
        written = {f.getPath().getName().removeprefix("_bucket=") for f in fs.listStatus(where) if f.isDirectory()}
        parts = {b: p for b, p in about["parts"].items() if int(b) not in set(touched)}
        parts |= {b: f"{folder}/_bucket={b}" for b in sorted(written)}
        self.tables = self.tables | {table: about | {"parts": parts}}

    def commit(self) -> int:
        """Makes what was written the next version. Raises if another change has made it already."""
        fs, target = self._fs(f"{self.path}/versions/{self.at + 1}.json")
        beside = f"{self.path}/versions/.{uuid.uuid4().hex}"
        out = fs.create(self._fs(beside)[1])
        out.write(bytearray(json.dumps(self.tables).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(self._fs(beside)[1], target):
            raise RuntimeError(f"version {self.at + 1} is there already: refresh and change again")
        self.at += 1
        return self.at
