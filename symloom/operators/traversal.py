"""Walks over the file and node graph: breadth-first search, reach, page ranks, rule expansion.

Loops run a fixed number of rounds or until a frontier is empty; between rounds tables are written to the shared
folder, so that a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.graph import Graph
from ..sources.shared import stored
from .lookups import file_edges

#: Weights of edges by type.
TYPE_WEIGHTS = {"CALLS": 1.0, "IMPORTS": 0.8, "EXTENDS": 0.9, "USES": 0.5}


def _cut(df: DataFrame) -> DataFrame:
    """A table in the shared folder."""
    return stored(df, "walk")


def type_weight() -> F.Column:
    out = F.lit(0.3)
    for kind, weight in TYPE_WEIGHTS.items():
        out = F.when(F.col("type") == kind, weight).otherwise(out)
    return out


def bfs_files(g: Graph, seeds: DataFrame, depth: int = 3, edges: DataFrame | None = None) -> DataFrame:
    """Least distance of files from the seeds (file_path), over imports and calls in either direction."""
    e = file_edges(g, edges).select("source_file", "target_file").distinct()
    both = e.unionByName(e.select(F.col("target_file").alias("source_file"), F.col("source_file").alias("target_file"))).distinct()
    both = _cut(both)
    seen = seeds.select("file_path", F.lit(0).alias("distance")).distinct()
    front = seen
    for d in range(1, depth + 1):
        step = front.join(both, F.col("file_path") == F.col("source_file")).select(F.col("target_file").alias("file_path")).distinct()
        front = _cut(step.join(seen, "file_path", "left_anti").select("file_path", F.lit(d).alias("distance")))
        seen = seen.unionByName(front)
    return seen


def relevance(g: Graph, seeds: DataFrame, depth: int = 3, edges: DataFrame | None = None) -> DataFrame:
    """Scores 1 / 2^distance, half more where the file holds a class; under .2 left out."""
    holders = g.nodes.where("label = 'Class'").select("file_path").distinct().withColumn("boost", F.lit(1.5))
    b = bfs_files(g, seeds, depth, edges).join(holders, "file_path", "left")
    return b.select("file_path", "distance", F.round(F.pow(F.lit(0.5), F.col("distance")) * F.coalesce("boost", F.lit(1.0)), 6).alias("score")).where("score >= 0.2")


def reach(g: Graph, seeds: DataFrame, hops: int = 3, edges: DataFrame | None = None) -> DataFrame:
    """Sum over all walks of up to ``hops`` hops of the product of type weight and confidence, divided by hops and 1.

    Mass is linear, so a hop is a join and a sum; parallel edges and revisits count.
    """
    e = file_edges(g, edges).select("source_file", "target_file", (type_weight() * F.col("confidence")).alias("w"))
    e = _cut(e.groupBy("source_file", "target_file").agg(F.sum("w").alias("w")))
    mass, found = seeds.select("file_path", F.lit(1.0).alias("mass")).distinct(), None
    for hop in range(1, hops + 1):
        step = mass.join(e, F.col("file_path") == F.col("source_file"))
        mass = _cut(step.groupBy(F.col("target_file").alias("file_path")).agg(F.sum(F.col("mass") * F.col("w")).alias("mass")))
        now = mass.select("file_path", (F.col("mass") / (1.0 + hop)).alias("score"), F.lit(hop).alias("length"))
        found = now if found is None else found.unionByName(now)
    return found.groupBy("file_path").agg(F.round(F.sum("score"), 6).alias("score"), F.min("length").alias("length"))


def _moved(old: DataFrame, new: DataFrame, largest: bool) -> float:
    """The largest change of a rank, or the sum of all changes."""
    change = F.abs(F.col("rank") - F.col("_old"))
    joined = new.join(old.select("file_path", F.col("rank").alias("_old")), "file_path")
    return joined.agg(F.coalesce(F.max(change) if largest else F.sum(change), F.lit(0.0))).first()[0]


def personalized_pagerank(g: Graph, seeds: DataFrame, rounds: int = 30, alpha: float = 0.85, edges: DataFrame | None = None, tolerance: float | None = 1e-4) -> DataFrame:
    """Ranks of files over distinct unweighted edges; mass without a way out returns to the seeds.

    Ends after ``rounds`` rounds, or when no rank changes by ``tolerance`` (None: never).
    """
    e = file_edges(g, (g.edges if edges is None else edges).where("confidence >= 0.5")).select("source_file", "target_file").distinct()
    out = e.groupBy("source_file").agg(F.count(F.lit(1)).alias("out"))
    e = _cut(e.join(out, "source_file"))
    files = _cut(g.nodes.select("file_path").distinct())
    n = seeds.select("file_path").distinct().agg(F.count(F.lit(1)).alias("n"))
    start = files.join(seeds.select("file_path").distinct().withColumn("_s", F.lit(1.0)), "file_path", "left").crossJoin(F.broadcast(n))
    start = _cut(start.select("file_path", F.coalesce(F.col("_s") / F.col("n"), F.lit(0.0)).alias("seed")))
    rank = start.select("file_path", F.col("seed").alias("rank"))
    for _ in range(rounds):
        got = rank.join(e, F.col("file_path") == F.col("source_file")).groupBy(F.col("target_file").alias("file_path")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = rank.join(e.select(F.col("source_file").alias("file_path")).distinct(), "file_path", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        before, rank = rank, start.join(got, "file_path", "left").crossJoin(F.broadcast(lost)).select("file_path", ((1 - alpha) * F.col("seed") + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("seed"))).alias("rank"))
        rank = _cut(rank)
        if tolerance is not None and _moved(before, rank, True) < tolerance:
            break
    return rank.select("file_path", F.round("rank", 6).alias("rank"))


def weighted_pagerank(g: Graph, rounds: int = 50, alpha: float = 0.85, edges: DataFrame | None = None, tolerance: float | None = 1e-6) -> DataFrame:
    """Ranks of files over weighted edges from an even start; mass without a way out is lost.

    Ends after ``rounds`` rounds, or when all ranks together change by less than ``tolerance`` (None: never).
    """
    e = file_edges(g, edges).groupBy("source_file", "target_file").agg(F.sum("confidence").alias("w"))
    out = e.groupBy("source_file").agg(F.sum("w").alias("out"))
    e = _cut(e.join(out, "source_file"))
    files = g.nodes.select("file_path").distinct()
    n = files.agg(F.count(F.lit(1)).alias("n"))
    start = _cut(files.crossJoin(F.broadcast(n)).select("file_path", (1.0 / F.col("n")).alias("even")))
    rank = start.select("file_path", F.col("even").alias("rank"))
    for _ in range(rounds):
        got = rank.join(e, F.col("file_path") == F.col("source_file")).groupBy(F.col("target_file").alias("file_path")).agg(F.sum(F.col("rank") * F.col("w") / F.col("out")).alias("got"))
        before, rank = rank, _cut(start.join(got, "file_path", "left").select("file_path", ((1 - alpha) * F.col("even") + alpha * F.coalesce("got", F.lit(0.0))).alias("rank")))
        if tolerance is not None and _moved(before, rank, False) < tolerance:
            break
    return rank.select("file_path", F.round("rank", 6).alias("rank"))


def callee_closure(g: Graph, seeds: DataFrame, depth: int = 3, edges: DataFrame | None = None) -> DataFrame:
    """Nodes that the seeds (id) reach by calls, with the least number of hops; every hop is gated."""
    e = _cut((g.edges if edges is None else edges).where("type = 'CALLS' AND confidence >= 0.5").select("source_id", "target_id"))
    seen = seeds.select("id", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(e, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id")).distinct()
        front = _cut(step.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth")))
        seen = seen.unionByName(front)
    return seen


def expand_by_rules(g: Graph, seeds: DataFrame, per_seed: int = 3, most: int = 50) -> DataFrame:
    """Nodes next to the seeds by rule: callers .8, callees .6, same class .7; few of a rule for a seed, ``most`` in all."""
    s = seeds.select(F.col("id").alias("seed"))
    calls = g.edges.where("type = 'CALLS'")
    callers = calls.join(s, F.col("target_id") == F.col("seed")).select("seed", F.col("source_id").alias("id"), F.lit("callers").alias("rule"), F.lit(0.8).alias("weight"))
    callees = calls.join(s, F.col("source_id") == F.col("seed")).select("seed", F.col("target_id").alias("id"), F.lit("callees").alias("rule"), F.lit(0.6).alias("weight"))
    parents = g.nodes.where("parent_id IS NOT NULL").select("id", "parent_id")
    mine = parents.join(s, F.col("id") == F.col("seed")).select("seed", "parent_id")
    same = mine.join(parents, "parent_id").where("id <> seed").select("seed", "id", F.lit("same_class").alias("rule"), F.lit(0.7).alias("weight"))
    every = callers.unionByName(callees).unionByName(same).distinct()
    quota = every.withColumn("_k", F.row_number().over(Window.partitionBy("seed", "rule").orderBy("id"))).where(F.col("_k") <= per_seed).drop("_k")
    return quota.orderBy(F.desc("weight"), "seed", "rule", "id").limit(most)


def anchor_proximity(g: Graph, anchors: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Distinct anchor files next to each file."""
    e = file_edges(g, edges).select("source_file", "target_file").distinct()
    both = e.unionByName(e.select(F.col("target_file").alias("source_file"), F.col("source_file").alias("target_file"))).distinct()
    return both.join(anchors.select(F.col("file_path").alias("source_file")), "source_file").groupBy(F.col("target_file").alias("file_path")).agg(F.count(F.lit(1)).alias("anchors"))


def ego_graph(g: Graph, seeds: DataFrame, callees: int = 4, callers: int = 3) -> DataFrame:
    """Each seed's first callees and callers from other files."""
    s = seeds.join(g.nodes.select("id", F.col("file_path").alias("seed_file")), "id").select(F.col("id").alias("seed"), "seed_file")
    calls = g.edges.where("type = 'CALLS'")
    down = calls.join(s, F.col("source_id") == F.col("seed")).withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("source_line", "target_id"))).where(F.col("_k") <= callees).select("seed", F.col("target_id").alias("id"), F.lit("callee").alias("relation"))
    up = calls.join(s, F.col("target_id") == F.col("seed")).where("source_file <> seed_file").withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("confidence"), "source_id"))).where(F.col("_k") <= callers).select("seed", F.col("source_id").alias("id"), F.lit("caller").alias("relation"))
    return down.unionByName(up)


def base_methods(g: Graph) -> DataFrame:
    """Methods whose class extends one that has a method of the same name."""
    m = g.nodes.where("parent_id IS NOT NULL").select("id", "name", F.col("parent_id").alias("source_id"))
    b = g.nodes.where("parent_id IS NOT NULL").select(F.col("id").alias("base_id"), "name", F.col("parent_id").alias("target_id"))
    return g.edges.where("type = 'EXTENDS'").select("source_id", "target_id").join(m, "source_id").join(b, ["target_id", "name"]).select("id", "base_id", "name")
