"""What the pipeline's stages do with the operators' verdicts: rows of the documents leave, stay or repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Up to this many keys are sent to every executor; more meet the documents by a shuffle.
BROADCAST_KEYS = 500_000


def row_key(columns: list[str]) -> Column:
    """A hash of a row's columns that tells nulls from values."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*parts)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` less the rows whose ``key`` is in the one column of ``gone``.

    All rows of a key go, repeated ones too; an empty ``gone`` takes none. Columns of any name stay.
    """
    name = fresh(docs, "_gone")
    gone = written(gone.toDF(name).distinct(), "stage-gone")
    few = gone.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, key == F.col(name), "left_anti")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each group of ``groups`` (doc_id, component_id): that with the smallest id.

    Of rows repeated with their id one stays. A row without an id stays where its group has no id; of such rows with
    equal texts one stays.
    """
    groups = written(groups.select("doc_id", "component_id"), "stage-groups")
    repeated = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    out = without(docs.where("doc_id IS NOT NULL"), groups.where("doc_id <> component_id").select("doc_id"), F.col("doc_id"))
    if not repeated.isEmpty():
        twice = written(repeated, "stage-repeated").withColumnRenamed("doc_id", "_id")
        again = out.join(twice, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id"])
        out = out.join(twice, F.col("doc_id") == F.col("_id"), "left_anti").unionByName(again)
    nameless = docs.where("doc_id IS NULL")
    if groups.where("doc_id IS NULL").isEmpty():
        return out
    linked = groups.where("doc_id IS NULL AND component_id IS NOT NULL").isEmpty()
    return out.unionByName(nameless.dropDuplicates(["text"])) if linked else out


def first_of_each(docs: DataFrame, groups: DataFrame, key: Column) -> DataFrame:
    """Of each group of ``groups`` (doc_id, row, label) the row with the smallest id, decided by row; ``key``: a row's key.

    Rows without a label link with nothing and stay. Rows without an id come last in their group. Of rows with equal
    keys one stays.
    """
    groups = written(groups.select("doc_id", "row", "label"), "stage-groups")
    labelled = groups.where("label IS NOT NULL")
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first"))
    others = labelled.join(first.select(F.col("first.row").alias("_first")), F.col("row") == F.col("_first"), "left_anti")
    row, many = fresh(docs, "_row"), fresh(docs, "_again")
    out = without(docs, others.select("row"), key).withColumn(row, key)
    again = written(groups.groupBy("row").count().where("count > 1").select(F.col("row").alias(many)), "stage-repeated")
    if again.isEmpty():
        return out.drop(row)
    once = out.join(again, F.col(row) == F.col(many), "left_semi").dropDuplicates([row])
    return out.join(again, F.col(row) == F.col(many), "left_anti").unionByName(once).drop(row)


def repeated(docs: DataFrame, mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``docs`` as often as ``mixed`` (key, size, taken) takes it, to a whole number; not at all is possible.

    A part of a time becomes a whole one with that chance, by a hash of the key. Rows without words stay once.
    """
    at, key, times_ = (fresh(docs, n) for n in ("_at", "_key", "_times"))
    share = F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))
    chance = F.pmod(F.xxhash64(F.lit("times"), "key"), F.lit(1 << 30)) / float(1 << 30)
    times = mixed.groupBy("key").agg(share.alias("_share"), F.max("size").alias("_size"))
    times = times.select(F.col("key").alias(key), F.when(F.col("_size") == 0, 1).otherwise(F.floor(F.col("_share") + chance)).cast("int").alias(times_))
    times = written(times, "stage-times")
    few = times.count() <= BROADCAST_KEYS
    joined = docs.withColumn(at, row_key(columns)).join(F.broadcast(times) if few else times, F.col(at) == F.col(key)).where(F.col(times_) > 0)
    return joined.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(times_)))).select(*docs.columns)
