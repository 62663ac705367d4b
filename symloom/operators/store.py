"""The graph's tables on disk: declared schemas, checks, appends, upserts, deletes, logs and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: The tables with their columns.
SCHEMAS = {
    "nodes": "id BIGINT, label STRING, name STRING, qualified_name STRING, file_path STRING, start_line INT, end_line INT, signature STRING, return_type STRING, is_exported BOOLEAN, is_test BOOLEAN, language STRING, parent_id BIGINT",
    "edges": "id BIGINT, source_id BIGINT, target_id BIGINT, type STRING, source_line INT, source_file STRING, resolution_method STRING, confidence DOUBLE, trust_tier STRING, candidate_count INT",
    "properties": "id BIGINT, node_id BIGINT, kind STRING, value STRING, line INT, confidence DOUBLE",
    "assertions": "id BIGINT, test_node_id BIGINT, target_node_id BIGINT, kind STRING, expression STRING, expected STRING, line INT",
    "commit_files": "commit_id BIGINT, ts TIMESTAMP, file_path STRING",
    "interventions": "id BIGINT, ts TIMESTAMP, tool STRING, run_id BIGINT, phase STRING, outcome STRING, latency_ms INT, ai_called BOOLEAN, props STRING",
    "packages": "name STRING, version STRING, package_manager STRING, is_dev BOOLEAN",
    "file_hashes": "file_path STRING, hash STRING, language STRING",
}


def check_columns(df: DataFrame, name: str) -> list[str]:
    """What a table lacks against its schema: missing columns and those of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f.name for f in StructType.fromDDL(SCHEMAS[name]).fields if have.get(f.name) != f.dataType.simpleString()]


def _path(path: str, name: str) -> str:
    return f"{path}/{name}.parquet"


def create(spark: SparkSession, path: str) -> None:
    """Empty tables where there are none."""
    for name, schema in SCHEMAS.items():
        if not _exists(spark, _path(path, name)):
            spark.createDataFrame([], schema).write.parquet(_path(path, name))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(_path(path, name))


def append(df: DataFrame, path: str, name: str) -> None:
    """Adds rows to a table; columns are brought into its order, missing ones are null. Rows that break the schema raise."""
    fields = StructType.fromDDL(SCHEMAS[name]).fields
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    df.select(*columns).write.mode("append").parquet(_path(path, name))


def replace(df: DataFrame, path: str, name: str) -> None:
    """Puts ``df``, which may read the table, in its place: written beside it and then moved."""
    spark = df.sparkSession
    beside = f"{_path(path, name)}-{uuid.uuid4().hex}"
    df.select(*[f.name for f in StructType.fromDDL(SCHEMAS[name]).fields]).write.parquet(beside)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(beside).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(_path(path, name)), True)
    fs.rename(fs_path(beside), fs_path(_path(path, name)))


def numbered(df: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """``df`` with an id by an order of its rows, whatever its partitions: rows are ranked within each value of the leading
    column, and values counted before, one row a value.

    Ties of the order get their ids in any order.
    """
    lead = order[0]
    before = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(F.col(lead).alias("_lead")).agg(F.count(F.lit(1)).alias("_n")).select("_lead", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(lead).orderBy(*order)))
    return ranked.join(counts, F.col(lead).eqNullSafe(F.col("_lead"))).select((F.col("_before") + F.col("_r") + (first - 1)).alias("id"), *df.columns)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with ``new`` in place of the rows of its keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def without_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """The tables without some files (file_path): their nodes, edges from or into them, and what hangs on their nodes."""
    gone = tables["nodes"].join(files, "file_path", "left_semi").select(F.col("id").alias("_gone"))
    anti = lambda df, key: df.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    out = dict(tables)
    out["nodes"] = tables["nodes"].join(files, "file_path", "left_anti")
    out["edges"] = anti(tables["edges"].join(files.withColumnRenamed("file_path", "source_file"), "source_file", "left_anti").select(*tables["edges"].columns), "target_id")
    for name, key in (("properties", "node_id"), ("assertions", "test_node_id")):
        if name in tables:
            out[name] = anti(tables[name], key)
    return out


def with_outcome(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A briefing log (id, ...) with the outcomes (id, compliance, validation_id) that came later; others stay null."""
    return log.join(outcomes.select("id", "compliance", "validation_id"), "id", "left")


def token_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index of texts: token, key and tf; an update replaces whole documents by :func:`upserted`."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")
    return docs.select(key, F.explode(tokens).alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"))


def append_json(df: DataFrame, path: str) -> None:
    """Records as lines of JSON, added to a folder."""
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder of JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parsed_lines(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """The records of lines of JSON; malformed ones are left out."""
    parsed = F.from_json(text, schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("_j", parsed).where("_j._bad IS NULL AND _j IS NOT NULL").select(*[c for c in lines.columns if c != text], F.col("_j").alias("record"))


def file_status(known: DataFrame, present: DataFrame) -> DataFrame:
    """new, changed, unchanged or deleted by modification time and size (file_path, mtime, size)."""
    k = known.select("file_path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(1).alias("_k"))
    p = present.select("file_path", "mtime", "size", F.lit(1).alias("_p"))
    j = k.join(p, "file_path", "full")
    same = (F.col("_m") == F.col("mtime")) & (F.col("_s") == F.col("size"))
    return j.select("file_path", F.when(F.col("_k").isNull(), "new").when(F.col("_p").isNull(), "deleted").when(same, "unchanged").otherwise("changed").alias("status"))


def worst_freshness(states: DataFrame) -> DataFrame:
    """The worst of freshness states: FRESH, SLIGHTLY_STALE, STALE."""
    rank = F.when(F.col("freshness") == "FRESH", 0).when(F.col("freshness") == "SLIGHTLY_STALE", 1).otherwise(2)
    return states.agg(F.element_at(F.array(F.lit("FRESH"), F.lit("SLIGHTLY_STALE"), F.lit("STALE")), F.max(rank) + 1).alias("freshness"))
