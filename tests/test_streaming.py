"""Streams over event files against the batch answers."""

import shutil

from pyspark.sql import functions as F

from symloom.streaming import sessions


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_session_totals(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events.parquet")
    stream = sessions.session_totals(sessions.event_source(spark, str(tmp_path)))
    drained(stream.writeStream.outputMode("complete").format("memory").queryName("totals").start())
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"))
    assert {tuple(r) for r in spark.table("totals").select("user_id", "calls").collect()} == {tuple(r) for r in batch.collect()}


def test_windowed_counts(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.windowed_counts(sessions.event_source(spark, str(tmp_path / "in")))
    drained(stream.writeStream.outputMode("update").format("memory").queryName("counts").start())
    n = spark.table("counts").agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_novelty(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events.parquet")
    stream = sessions.stream_novelty(sessions.event_source(spark, str(tmp_path)))
    drained(stream.writeStream.outputMode("append").format("memory").queryName("news").start())
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct().count()
    assert spark.table("news").count() == batch
