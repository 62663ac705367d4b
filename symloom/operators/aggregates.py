"""Counts, statistics, percentiles and rankings over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ADMISSIBLE, directory, evidence_tier, parameter_count
from ..sources.graph import Graph
from .lookups import file_edges, gate, usage


def hotspots(g: Graph, most: int = 20) -> DataFrame:
    """The nodes outside of tests with the most incoming edges."""
    return usage(g).join(g.nodes.where("NOT is_test").select("id", "name", "file_path"), "id").orderBy(F.desc("usage_count"), "id").limit(most)


def store_stats(g: Graph) -> DataFrame:
    n = g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file_path").alias("files"), F.count_if("is_test").alias("tests"), F.count_if("is_exported").alias("exported"))
    e = g.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("type") == "CALLS").alias("calls"), F.count_if(F.col("confidence") >= 0.9).alias("sure"))
    return n.crossJoin(e)  # one row each


def property_counts(g: Graph) -> DataFrame:
    return g.properties.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("nodes"))


def entry_point_files(g: Graph, most: int = 10) -> DataFrame:
    """Files by incoming edges."""
    t = g.nodes.select(F.col("id").alias("target_id"), "file_path")
    return g.edges.join(t, "target_id").groupBy("file_path").agg(F.count(F.lit(1)).alias("incoming")).orderBy(F.desc("incoming"), "file_path").limit(most)


def top_directories(g: Graph) -> DataFrame:
    """Folders by number of files and symbols."""
    return g.nodes.withColumn("dir", directory(F.col("file_path"))).groupBy("dir").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def module_symbols(g: Graph) -> DataFrame:
    """Symbols under each prefix of a path."""
    parts = F.split("file_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return g.nodes.select(F.explode(prefixes).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("symbols"))


def confidence_stats(g: Graph) -> DataFrame:
    """Share of sure edges, exact median of calls' confidence and the threshold that readers take from it."""
    share = g.edges.agg(F.round(F.avg((F.col("confidence") >= 0.7).cast("double")), 6).alias("high_share"))
    median = g.edges.where("type = 'CALLS'").agg(F.expr("percentile(confidence, 0.5)").alias("median"))
    both = share.crossJoin(median)  # one row each
    return both.select(F.coalesce("high_share", F.lit(0.0)).alias("high_share"), F.coalesce("median", F.lit(0.5)).alias("median"), F.when((F.col("median") > 0) & (F.col("median") <= 0.9), F.col("median")).otherwise(0.5).alias("threshold"))


def in_degree(g: Graph) -> DataFrame:
    """Incoming calls of each file."""
    t = g.nodes.select(F.col("id").alias("target_id"), "file_path")
    return g.edges.where("type = 'CALLS'").join(t, "target_id").groupBy("file_path").agg(F.count(F.lit(1)).alias("degree"))


def hub_penalty(g: Graph, scale: float = 50.0) -> DataFrame:
    return in_degree(g).select("file_path", "degree", F.round(F.tanh(F.col("degree") / scale), 6).alias("penalty"))


def caller_counts(g: Graph) -> DataFrame:
    """Gated callers of each node and the files that they are in."""
    return g.edges.where((F.col("type") == "CALLS") & gate(0.5, ADMISSIBLE)).groupBy("target_id").agg(F.count(F.lit(1)).alias("callers"), F.countDistinct("source_file").alias("files"))


def _at_rank(df: DataFrame, value: str, rank: F.Column) -> DataFrame:
    """The value at a 1-based rank among all rows, from counts by value (rank may use the column n, all rows)."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    run = counts.withColumn("_run", F.sum("_c").over(Window.orderBy(value)))  # a row a distinct value
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return run.crossJoin(F.broadcast(n)).where(F.col("_run") >= rank).groupBy("n").agg(F.min(value).alias(value))


def blast_radius_p95(g: Graph) -> DataFrame:
    """The count at place round-half-even(0.95 (n - 1)) of files' incoming calls, 5 at least; 20 under 5 files."""
    at = _at_rank(in_degree(g), "degree", F.expr("bround(0.95D * (n - 1)) + 1"))
    return at.select("n", F.when(F.col("n") < 5, 20).otherwise(F.greatest(F.lit(5), F.col("degree"))).cast("long").alias("threshold"))


def hub_scale_p90(g: Graph) -> DataFrame:
    """The degree at place floor(0.9 n)."""
    return _at_rank(in_degree(g), "degree", F.expr("least(floor(0.9D * n) + 1, n)")).select("n", F.col("degree").alias("p90"))


def high_frequency_names(g: Graph, least: int = 5) -> DataFrame:
    """Names of at least ``least`` nodes, the top hundredth of them, one at least."""
    counts = g.nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    k = counts.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 100)).alias("k"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "name")))  # a row a name
    return ranked.crossJoin(F.broadcast(k)).where("rank <= k").select("name", "n")


def impact_radius(g: Graph) -> DataFrame:
    """Files that refer to any node of a name."""
    names = g.nodes.select(F.col("id").alias("target_id"), "name")
    return g.edges.join(names, "target_id").groupBy("name").agg(F.countDistinct("source_file").alias("files"), F.min("source_file").alias("first_file"))


def impact_summary(g: Graph) -> DataFrame:
    """Level of impact of each node by its gated callers."""
    n = F.col("callers")
    return caller_counts(g).select("target_id", "callers", F.when(n >= 5, "HIGH").when(n >= 2, "MODERATE").otherwise("LOW").alias("level"))


def blast_radius(g: Graph) -> DataFrame:
    """For each file the calls into it, the files and the nodes that call, and how much that is."""
    t = g.nodes.select(F.col("id").alias("target_id"), "file_path")
    into = g.edges.where("type = 'CALLS'").join(t, "target_id").groupBy("file_path").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("source_file").alias("files"), F.countDistinct("source_id").alias("callers"))
    return into.withColumn("penalty", F.round(F.tanh(F.col("calls") / 50.0), 6))


def cochange_pairs(g: Graph, least: int = 3, most_files: int = 50, commits: int = 500) -> DataFrame:
    """Pairs of files that the last commits change together, without commits of very many files."""
    last = g.commit_files.groupBy("commit_id", "ts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_files).orderBy(F.desc("ts"), F.desc("commit_id")).limit(commits)
    files = g.commit_files.join(last.select("commit_id"), "commit_id", "left_semi").select("commit_id", "file_path")
    a, b = files.withColumnRenamed("file_path", "file_a"), files.withColumnRenamed("file_path", "file_b")
    return a.join(b, "commit_id").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def recency_weight(g: Graph, days: int = 365) -> DataFrame:
    """ln(c + 1) / ln(max + 1) of files' commits in the last days."""
    last = g.commit_files.agg(F.max("ts").alias("last"))
    recent = g.commit_files.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {days} DAYS"))
    counts = recent.groupBy("file_path").agg(F.count(F.lit(1)).alias("commits"))
    top = counts.agg(F.max("commits").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("file_path", "commits", F.round(F.log1p("commits") / F.log1p("top"), 6).alias("weight"))


def cochange_cluster(g: Graph, primary: str | None = None, commits: int = 500) -> DataFrame:
    """Files by the sum of 1 / ln(place + 3) of the last commits that touch the primary file."""
    files = g.commit_files
    first = files.agg(F.min("file_path").alias("primary")) if primary is None else g.spark.range(1).select(F.lit(primary).alias("primary"))
    last = files.groupBy("commit_id", "ts").count().orderBy(F.desc("ts"), F.desc("commit_id")).limit(commits)
    placed = last.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("commit_id"))) - 1)  # ``commits`` rows
    named = files.join(placed.select("commit_id", "place"), "commit_id").crossJoin(F.broadcast(first))
    touched = named.where("file_path = primary").select("commit_id")
    scores = named.join(touched, "commit_id", "left_semi").groupBy("file_path", "primary").agg(F.sum(1.0 / F.log(F.col("place") + 3.0)).alias("s"))
    return scores.select("file_path", F.round(F.col("s") + F.when(F.col("file_path") == F.col("primary"), 2.0).otherwise(0.0), 6).alias("score"))


def top_functions_per_file(g: Graph, most: int = 3) -> DataFrame:
    counts = usage(g, "CALLS")
    f = g.nodes.where(F.col("label").isin("Function", "Method")).join(counts, "id", "left").select("file_path", "id", "name", F.coalesce("usage_count", F.lit(0)).alias("refs"))
    order = Window.partitionBy("file_path").orderBy(F.desc("refs"), "name", "id")
    return f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def top_symbols_by_degree(g: Graph, most: int = 3) -> DataFrame:
    """Per file the nodes of the highest degree, both directions."""
    ends = g.edges.select(F.col("source_id").alias("id")).unionByName(g.edges.select(F.col("target_id").alias("id")))
    d = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    f = g.nodes.join(d, "id", "left").select("file_path", "id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("degree"), "id"))).where(F.col("rank") <= most)


def focus_functions(g: Graph, per_file: int = 2, most: int = 10) -> DataFrame:
    """The functions with most callers, not too many of a file."""
    f = g.nodes.where("label IN ('Function', 'Method') AND NOT is_test").join(usage(g, "CALLS"), "id").select("file_path", "id", "name", "usage_count")
    kept = f.withColumn("_k", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("usage_count"), "id"))).where(F.col("_k") <= per_file)
    return kept.orderBy(F.desc("usage_count"), "id").limit(most).select("id", "name", "file_path", "usage_count")


def hub_penalized(g: Graph, first: int = 50, most: int = 10) -> DataFrame:
    """The files with most calls, ranked anew by count times (1 - min(1, degree / p90))."""
    degree = in_degree(g)
    p90 = hub_scale_p90(g).select("p90")
    out = file_edges(g).groupBy(F.col("source_file").alias("file_path")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(first)
    scored = out.join(degree, "file_path", "left").crossJoin(F.broadcast(p90)).select("file_path", F.round(F.col("n") * (1 - F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / F.col("p90"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "file_path").limit(most)


def evidence_tiers(g: Graph) -> DataFrame:
    return g.edges.groupBy("type", evidence_tier(F.col("confidence")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def risk_scores(g: Graph, most: int = 50, edges: DataFrame | None = None) -> DataFrame:
    """Files by a weighted sum of crowding, naming, arity, unused exports, ambiguity and centrality."""
    f = g.nodes.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if("is_exported").alias("exported"),
        F.avg(parameter_count(F.col("signature"))).alias("params"),
        F.countDistinct("name").alias("names"),
    )
    used = g.nodes.where("is_exported").join((g.edges if edges is None else edges).select(F.col("target_id").alias("id")).distinct(), "id", "left_anti").groupBy("file_path").agg(F.count(F.lit(1)).alias("unused"))
    homonyms = g.nodes.groupBy("name").agg(F.countDistinct("file_path").alias("in_files"))
    shared = g.nodes.join(homonyms, "name").groupBy("file_path").agg(F.avg((F.col("in_files") > 1).cast("double")).alias("ambiguous"))
    j = f.join(used, "file_path", "left").join(shared, "file_path", "left").join(in_degree(g), "file_path", "left")
    one = F.lit(1.0)
    score = (
        0.25 * F.least(one, F.col("exported") / 30.0)
        + 0.15 * F.coalesce("ambiguous", F.lit(0.0))
        + 0.15 * F.least(one, F.col("params") / 5.0)
        + 0.15 * F.coalesce("unused", F.lit(0)) / F.greatest(F.col("exported"), F.lit(1))
        + 0.15 * (1 - F.col("names") / F.col("symbols"))
        + 0.15 * F.tanh(F.coalesce("degree", F.lit(0)) / 50.0)
    )
    return j.select("file_path", F.round(F.least(one, score), 6).alias("risk")).orderBy(F.desc("risk"), "file_path").limit(most)


def session_summary(g: Graph) -> DataFrame:
    """Runs: calls, tools, mean latency, errors and the first and last time."""
    return g.interventions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.countDistinct("tool").alias("tools"),
        F.count_if(F.col("outcome") == "errors_found").alias("errors"),
        F.count_if("ai_called").alias("ai_calls"),
        F.sum("latency_ms").alias("latency_ms"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def trace_analysis(g: Graph) -> DataFrame:
    """Tools by outcome with mean and extreme latency."""
    return g.interventions.groupBy("tool", "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.max("latency_ms").alias("max_ms"))


def compliance_stats(g: Graph, last: int = 1000) -> DataFrame:
    """Mean and exact median of the latest rows' latency."""
    rows = g.interventions.orderBy(F.desc("ts"), F.desc("id")).limit(last)
    return rows.agg(F.round(F.avg("latency_ms"), 6).alias("mean"), F.expr("percentile(latency_ms, 0.5)").alias("median"), F.count("latency_ms").alias("n"))


def token_accounting(g: Graph) -> DataFrame:
    """Estimated tokens (a quarter of the characters) by role of conversations."""
    return g.table("conversations").groupBy("role").agg(F.sum(F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4)).cast("long").alias("tokens"), F.count(F.lit(1)).alias("turns"))


def call_site_distribution(g: Graph) -> DataFrame:
    """Methods of resolution with their mean confidence and spread."""
    return g.edges.groupBy("resolution_method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.stddev_pop("confidence"), 6).alias("spread"))
