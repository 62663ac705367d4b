"""Scores blended, fused, tiered and scheduled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import rrf

#: Weights of the signals in the blended score, and the most that a hub costs.
BLEND = {"semantic": 0.25, "lexical": 0.35, "reach": 0.2, "proximity": 0.05}
MOST_HUB = 0.10


def term_relevance(docs: DataFrame, key: str, text: Column, terms: list[str]) -> DataFrame:
    """The share of terms that texts hold, for texts with any."""
    hits = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return docs.select(key, hits.alias("hits")).where("hits > 0").select(key, "hits", F.round(F.col("hits") / len(terms), 6).alias("relevance"))


def blended(signals: DataFrame, variant: str = "C", hub_weight: float = 0.15) -> DataFrame:
    """Ranks keys by a variant over (key, semantic, lexical, reach, proximity, hub), nulls are 0.

    A: semantic and lexical, normalised to their weights. B: reach and proximity likewise. C: all; reach counts less for hubs,
    and a hub costs, where the other evidence is smaller than that cost.
    """
    x = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in (*BLEND, "hub")}
    only = {"A": ("semantic", "lexical"), "B": ("reach", "proximity"), "C": tuple(BLEND)}[variant]
    scale = 1.0 if variant == "C" else sum(BLEND[n] for n in only)
    reach = x["reach"] * (1 - x["hub"]) if variant == "C" else x["reach"]
    evidence = sum(((BLEND[n] / scale) * (reach if n == "reach" else x[n]) for n in only), F.lit(0.0))
    cost = F.least(F.lit(MOST_HUB), F.lit(hub_weight))
    score = evidence - F.when(evidence < cost, cost * x["hub"]).otherwise(0.0) if variant == "C" else evidence
    return signals.select("key", F.round(score, 6).alias("score"))


def fused_files(lists: DataFrame, weights: dict[str, float], most: int = 50) -> DataFrame:
    """Fusion of scored lists (key, signal, score): ranks within each signal, ties by key; scores of 0 or less don't count."""
    rank = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("score"), "key"))
    return rrf(lists.where("score > 0").withColumn("rank", rank), weights, 60, most)


def fused_twice(lists: DataFrame, weights: dict[str, float], spread: DataFrame, seeds: int = 10, most: int = 100) -> DataFrame:
    """Fusion, then once more with a signal that the first fusion's best keys spread to others (key, to)."""
    first = fused_files(lists, weights, most)
    top = first.orderBy(F.desc("score"), "key").limit(seeds).select("key", "score")
    carried = spread.join(F.broadcast(top), "key").groupBy(F.col("to").alias("key")).agg(F.max("score").alias("score"))  # so many rows as seeds
    return fused_files(lists.unionByName(carried.withColumn("signal", F.lit("carried")).select(*lists.columns)), weights, most)


def caller_proximity(calls: DataFrame, file_ranks: DataFrame) -> DataFrame:
    """For called nodes (target_id) the best of their callers' files (source_file): .3 up to rank 10, .1 up to 50."""
    near = F.when(F.col("rank") <= 10, 0.3).when(F.col("rank") <= 50, 0.1).otherwise(0.0)
    return calls.join(file_ranks.withColumnRenamed("file_path", "source_file"), "source_file").groupBy("target_id").agg(F.max(near).alias("proximity"))


def tiers(ranked: DataFrame, verified: int = 3, warning: int = 5) -> DataFrame:
    """Tiers by rank (from 1)."""
    at = F.col("rank") - 1
    return ranked.withColumn("tier", F.when(at < verified, "VERIFIED").when(at < warning, "WARNING").otherwise("INFO"))


def governed(own: DataFrame, agent: DataFrame, most: int = 10) -> DataFrame:
    """Own and an agent's candidates (key, score) by the best of either and of .55 and .45 of both."""
    a = own.select("key", F.col("score").alias("g")).join(agent.select("key", F.col("score").alias("a")), "key", "full")
    g, x = F.coalesce("g", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    scored = a.select("key", F.round(F.greatest(g, x, 0.55 * g + 0.45 * x), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(most)


def should_expand(top: DataFrame, spread: float = 0.05) -> DataFrame:
    """Whether the three best scores lie so close that more candidates are worth a look."""
    best = top.orderBy(F.desc("score"), "key").limit(3)
    return best.agg((F.max("score") - F.min("score") <= spread).alias("expand"))


def bounded_union(own: DataFrame, agent: DataFrame, own_most: int, agent_most: int, ceiling: int) -> DataFrame:
    """The first own candidates (key, rank), then the agent's that are new, up to the ceiling: key, place."""
    a = own.where(F.col("rank") <= own_most).select("key", F.lit(0).alias("side"), "rank")
    b = agent.where(F.col("rank") <= agent_most).select("key", F.lit(1).alias("side"), "rank").join(a.select("key"), "key", "left_anti")
    place = F.row_number().over(Window.orderBy("side", "rank", "key"))  # two short lists
    return a.unionByName(b).withColumn("place", place).where(F.col("place") <= ceiling).select("key", "place")


def scheduled(records: DataFrame, preferred: int = 5, ceiling: int = 7) -> DataFrame:
    """Admits records (task, key, tier, score, confirmed) of each task and evicts beyond the limits.

    Tier 1 stays first, then confirmed ones, then by tier and score. Up to ``preferred`` are kept, and tier 1 or confirmed
    ones up to ``ceiling``: task, key, place.
    """
    evict = F.when(F.col("tier") == 1, 0).when(F.col("confirmed"), 1).otherwise(1 + F.col("tier"))
    order = Window.partitionBy("task").orderBy("_e", F.desc("score"), "key")
    placed = records.withColumn("_e", evict).withColumn("place", F.row_number().over(order))
    return placed.where((F.col("place") <= preferred) | ((F.col("place") <= ceiling) & (F.col("_e") <= 1))).select("task", "key", "place")


def disambiguated(candidates: DataFrame) -> DataFrame:
    """The best candidate of each name (name, id, name_match, module_match, homonyms, centrality) with its tier.

    .3 name, .4 module, .2 for few homonyms, .1 centrality; a lead under .15 over the second demotes a VERIFIED one.
    """
    score = F.round(0.3 * F.col("name_match") + 0.4 * F.col("module_match") + 0.2 / F.col("homonyms") + 0.1 * F.col("centrality"), 6)
    order = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    ranked = candidates.withColumn("score", score).withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order))
    sure = F.col("score") >= 0.7
    close = F.col("score") - F.col("_next") < 0.15
    tier = F.when(sure & ~F.coalesce(close, F.lit(False)), "VERIFIED").when(F.col("score") >= 0.4, "WARNING").otherwise("INFO")
    return ranked.where("_k = 1").select("name", "id", "score", tier.alias("tier"))


def greedy_lines(lines: DataFrame, budget: int) -> DataFrame:
    """Lines (task, place, text) of each task that fit a budget of tokens (a quarter of the characters): kept, suppressed, used.

    Lines are taken in order of place; one that doesn't fit what is left is skipped and the next ones are tried. A task's
    lines are those of one brief, whose sizes are folded in one row. Null texts take nothing; ties of place follow the size.
    """
    sized = lines.select("task", F.struct("place", F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("size")).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"))
    taken = F.aggregate(F.array_sort("xs"), start, lambda s, x: F.when(s["used"] + x["size"] <= budget, F.struct((s["used"] + x["size"]).alias("used"), (s["kept"] + 1).alias("kept"))).otherwise(s))
    folded = sized.groupBy("task").agg(F.collect_list("x").alias("xs")).select("task", F.size("xs").alias("n"), taken.alias("s"))
    return folded.select("task", F.col("s.kept").alias("kept"), (F.col("n") - F.col("s.kept")).alias("suppressed"), F.col("s.used").alias("used"))
