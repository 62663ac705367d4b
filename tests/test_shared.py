"""Stored tables of many rows are met by merging, however small their files are."""

from pyspark.sql import functions as F

from symloom.operators import resolver
from symloom.sources import shared


def test_large_stored_tables_are_never_broadcast(spark):
    large = shared.stored(spark.range(shared.MERGED_ROWS + 1).select((F.col("id") % 100).alias("id"), F.lit("x" * 500).alias("name")), "large")
    small = shared.stored(spark.range(50), "small")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    met = spark.range(1_000).join(large.select("id", "name").where("name <> ''"), "id")
    assert "BroadcastHashJoin" not in plan(met) and "SortMergeJoin" in plan(met)
    assert "BroadcastHashJoin" not in plan(spark.range(50).join(large.groupBy("id").count(), "id", "left"))
    assert "BroadcastHashJoin" in plan(spark.range(1_000).join(small, "id"))
    assert met.count() == shared.MERGED_ROWS + 1


def test_reexports_are_met_by_merging_at_every_hop(spark, monkeypatch):
    monkeypatch.setattr(shared, "MERGED_ROWS", 0)
    plans = []

    def stored(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.stored(df, label)

    monkeypatch.setattr(resolver, "stored", stored)
    index = spark.createDataFrame([(f"{i}.py", "x", f"{i + 1}.py") for i in range(5)], "file_path string, imported_name string, target_file string")
    nodes = spark.createDataFrame([("5.py", "x")], "file_path string, name string")
    got = {tuple(r) for r in resolver.through_reexports(index, nodes).collect()}
    assert got == {(f"{i}.py", "x", f"{j}.py") for i in range(5) for j in range(i + 1, min(i + 4, 5) + 1)}
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for p in plans)
