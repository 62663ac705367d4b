"""Session counters, drift and repeats over events, in batch and as streams.

Batch forms are windows over a run's events in order of time; stream forms give the same answers as events arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.graph import Graph


def _ordered() -> Window:
    return Window.partitionBy("run_id").orderBy("ts", "id")


def running_counters(g: Graph) -> DataFrame:
    """Each call's number in its run, and the errors so far."""
    upto = _ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.interventions.select("id", "run_id", F.row_number().over(_ordered()).alias("step"), F.sum((F.col("outcome") == "errors_found").cast("int")).over(upto).cast("long").alias("errors"))


def drift(g: Graph, least: int = 2) -> DataFrame:
    """Runs' first phase, their calls outside of it, and whether those are many."""
    first = F.first("phase").over(_ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = g.interventions.withColumn("first_phase", first).groupBy("run_id", "first_phase").agg(F.sum((F.col("phase") != F.col("first_phase")).cast("int")).cast("long").alias("outside"))
    return r.select("run_id", "first_phase", "outside", (F.col("outside") >= least).alias("drifts"))


def repeats(g: Graph, within: int = 5) -> DataFrame:
    """Calls of a tool that the run called within the last few."""
    before = F.collect_list("tool").over(_ordered().rowsBetween(-within, -1))
    r = g.interventions.select("id", "run_id", F.array_contains(before, F.col("tool")).alias("again"))
    return r.groupBy("run_id").agg(F.sum(F.col("again").cast("int")).cast("long").alias("repeats"), F.count(F.lit(1)).alias("calls"))


def replan_triggers(g: Graph) -> DataFrame:
    """The first step at which a run's errors reach three."""
    return running_counters(g).where("errors >= 3").groupBy("run_id").agg(F.min("step").alias("step"))


def novelty(g: Graph) -> DataFrame:
    """The first call of each run, tool and outcome."""
    order = Window.partitionBy("run_id", "tool", "outcome").orderBy("ts", "id")
    return g.interventions.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("id", "run_id", "tool", "outcome")


def sessions(g: Graph, gap: str = "6 hours") -> DataFrame:
    """Stretches of a run without a longer gap."""
    s = g.interventions.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return s.select("run_id", F.col("w.start").alias("start_ts"), "calls")


def event_source(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the events files that arrive in a folder."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events by window and type; windows close once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def stream_novelty(events: DataFrame, late: str = "31 days") -> DataFrame:
    """The first event of each user and type that comes in."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def session_totals(events: DataFrame) -> DataFrame:
    """Counters of each user, to be written in update or complete mode."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))
