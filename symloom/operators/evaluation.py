"""Retrieval metrics, rates, comparisons and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import wilson
from ..sources.graph import Graph


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """Of (query, rank of the first gold row or null): mean reciprocal rank and hit rates."""
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k), F.lit(False)).cast("double")), 6).alias(f"hit_{k}")
    return ranked.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), hit(1), hit(3), hit(5), hit(10))


def quality_rates(g: Graph) -> DataFrame:
    """Share of good documents by language with its Wilson interval."""
    d = g.table("labels").join(g.table("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))
    low, high = wilson(F.col("good"), F.col("n"))
    return d.select("lang", "n", "good", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def rollups(g: Graph) -> DataFrame:
    """Latency by phase: mean, exact median, 75th and 95th percentile."""
    p = lambda x: F.expr(f"percentile(latency_ms, {x})")
    return g.interventions.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean"), F.round(p(0.5), 6).alias("median"), F.round(p(0.75), 6).alias("p75"), F.round(p(0.95), 6).alias("p95"))


def ab_compare(g: Graph) -> DataFrame:
    """Users by whether they err in the first and in the second half of the month."""
    half = F.when(F.dayofmonth("ts") <= 15, "a").otherwise("b")
    u = g.interventions.withColumn("half", half).groupBy("run_id").agg(F.max(F.when(F.col("half") == "a", (F.col("outcome") == "valid").cast("int"))).alias("a"), F.max(F.when(F.col("half") == "b", (F.col("outcome") == "valid").cast("int"))).alias("b"))
    status = F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "lost").when(F.col("b") == 1, "gained").otherwise("neither")
    return u.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("runs"))


def category_table(g: Graph) -> DataFrame:
    return g.table("labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


def graph_metrics(g: Graph) -> DataFrame:
    """Edges for each file of the graph, and the in-degree of calls at nine tenths of the called nodes, by rank from 0."""
    files = g.nodes.agg(F.countDistinct("file_path").alias("files"))
    edges = g.edges.agg(F.count(F.lit(1)).alias("edges"))
    degrees = g.edges.where("type = 'CALLS'").groupBy("target_id").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    # from counts by degree: the smallest degree with more nodes up to it than the rank
    run = F.sum("n").over(Window.orderBy("degree"))  # a row a degree
    total = degrees.agg(F.sum("n").alias("total"))
    at = degrees.withColumn("run", run).crossJoin(F.broadcast(total)).where(F.col("run") > F.floor(F.col("total") * 0.9)).agg(F.min("degree").alias("p90"))
    return files.crossJoin(edges).crossJoin(at).select("files", "edges", F.round(F.col("edges") / F.col("files"), 6).alias("edges_per_file"), "p90")  # one row each


def file_edge_counts(g: Graph) -> DataFrame:
    """Edges of each file, their targets, and the mean confidence in whole tenths."""
    tenths = F.sum(F.round(F.col("confidence") * 10).cast("long")) / (F.count(F.lit(1)) * 10)
    return g.edges.groupBy("source_file").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("target_id").alias("targets"), F.round(tenths, 6).alias("confidence"))


def gold_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """For each query the first rank whose path ends with a gold path or the other way round: query, rank (null if none).

    ``ranked``: query, path, rank; ``gold``: query, gold.
    """
    ends = F.col("path").endswith(F.col("gold")) | F.col("gold").endswith(F.col("path"))
    found = ranked.join(gold, "query").where(ends).groupBy("query").agg(F.min("rank").alias("rank"))
    return gold.select("query").distinct().join(found, "query", "left")


def envelope_confidence(signals: DataFrame, k: int = 5) -> DataFrame:
    """For each query over its top ``k`` (query, key, rank, score, a, b, c): agreement, separation, redundancy and their product.

    Agreement is 1 less the mean of the signals' variation over those that aren't 0, separation the lead of the first over
    the next after ``k``, redundancy the share with two signals and more.
    """
    x = F.filter(F.array("a", "b", "c"), lambda v: v > 0)
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    top = signals.withColumn("_cv", F.when(n > 0, spread / mean)).withColumn("_n", n)
    out = top.groupBy("query").agg(
        F.round(1 - F.avg(F.when(F.col("rank") <= k, F.coalesce("_cv", F.lit(1.0)))), 6).alias("agreement"),
        F.round(F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == k + 1, F.col("score"))), F.lit(0.0)), 6).alias("separation"),
        F.round(F.avg(F.when(F.col("rank") <= k, (F.col("_n") >= 2).cast("double"))), 6).alias("redundancy"),
    )
    return out.withColumn("confidence", F.round(F.col("agreement") * F.col("separation") * F.col("redundancy"), 6))


def compared(baseline: DataFrame, treated: DataFrame, key: str) -> DataFrame:
    """Tasks solved (key, solved) by either, both or neither of two runs; a task that a run lacks isn't solved."""
    both = baseline.select(key, F.col("solved").alias("_a")).join(treated.select(key, F.col("solved").alias("_b")), key, "full")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return both.select(key, F.when(a & b, "both").when(a, "lost").when(b, "gained").otherwise("neither").alias("status"))


def latest_blocks(records: DataFrame) -> DataFrame:
    """The last record of each task and block (task, block, ts, id, value)."""
    return records.groupBy("task", "block").agg(F.max_by(F.struct("id", "value"), F.struct("ts", "id")).alias("r")).select("task", "block", "r.id", "r.value")


def utilisation(calls: DataFrame) -> DataFrame:
    """Calls by layer, the share of tasks that use it, and the exact median of calls by task that does (task, layer)."""
    per_task = calls.groupBy("task", "layer").agg(F.count(F.lit(1)).alias("n"))
    tasks = calls.agg(F.countDistinct("task").alias("tasks"))
    by = per_task.groupBy("layer").agg(F.sum("n").alias("calls"), F.count(F.lit(1)).alias("used"), F.expr("percentile(n, 0.5)").alias("median"))
    return by.crossJoin(F.broadcast(tasks)).select("layer", "calls", F.round(F.col("used") / F.col("tasks"), 6).alias("share"), "median")  # one row


def verdicts(results: DataFrame) -> DataFrame:
    """Tasks by verdict of their reward (null: noverdict, 1 and more: resolved), with tokens and cost."""
    verdict = F.when(F.col("reward").isNull(), "noverdict").when(F.col("reward") >= 1, "resolved").otherwise("failed")
    return results.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("tasks"), F.sum("tokens").alias("tokens"))


def pilot_stop(tasks: DataFrame, most_worse: int, least_advantage: float) -> DataFrame:
    """Whether a pilot may go on: few tasks worse, and on average fewer files (task, before, after)."""
    out = tasks.agg(F.count_if(F.col("after") > F.col("before")).alias("worse"), F.count_if(F.col("after") < F.col("before")).alias("better"), F.round(F.avg(F.col("before") - F.col("after")), 6).alias("advantage"))
    return out.withColumn("pass", (F.col("worse") <= most_worse) & (F.col("advantage") >= least_advantage))


def tiered_cost(tokens: Column, threshold: int, below: float, above: float) -> Column:
    """The price of tokens: one rate for a million up to the threshold, another beyond."""
    return F.round((F.least(tokens, F.lit(threshold)) * below + F.greatest(tokens - threshold, F.lit(0)) * above) / 1e6, 6)


def cost_ledger(calls: DataFrame) -> DataFrame:
    """Tokens and cost by task (task, input_tokens, output_tokens)."""
    by = calls.groupBy("task").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    band = F.when(F.col("input_tokens") < 10_000, "small").when(F.col("input_tokens") < 100_000, "middle").otherwise("large")
    return by.select("task", "input_tokens", "output_tokens", band.alias("band"), tiered_cost(F.col("input_tokens"), 50_000, 1.25, 2.5).alias("cost"))


def bucket_rates(g: Graph) -> DataFrame:
    """Share of good documents by bucket of length, and the correlation of both."""
    d = g.table("labels").join(g.table("documents").select("doc_id", "n_chars"), "doc_id")
    bucket = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return d.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("good"))


def correlation(g: Graph) -> DataFrame:
    d = g.table("labels").join(g.table("documents").select("doc_id", "n_chars"), "doc_id")
    return d.agg(F.round(F.corr(F.col("quality").cast("double"), F.col("n_chars").cast("double")), 6).alias("r"), F.count(F.lit(1)).alias("n"))


def envelope(g: Graph) -> DataFrame:
    """Population coefficient of variation of files' edge confidence."""
    e = g.edges.groupBy("source_file").agg(F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("spread"))
    return e.select("source_file", F.round(F.when(F.col("mean") > 0, F.col("spread") / F.col("mean")).otherwise(0.0), 6).alias("cv"))


def deduplicated(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in names])
