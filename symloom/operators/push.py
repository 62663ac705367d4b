"""Personalised page ranks of nodes for many sets of seeds at once, by pushing what is left.

Each set begins with a mass of 1 on its seeds. A push keeps a part of a node's mass as its rank and passes the rest to its
neighbours in equal parts; nodes without a way out pass theirs to the seeds. Only nodes with enough mass push, all of them in
a round, so that a round costs the edges of its frontier and not those of the graph; it ends when the frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from ..sources.shared import stored

#: Mass that a node keeps for itself in a round where it has less: what is left unpushed is no rank's error by more in sum.
LEAST = 1e-7
#: Rounds after which what the frontiers left is summed up once.
MERGED = 8


def node_ranks(g: Graph, seeds: DataFrame, alpha: float = 0.85, least: float = LEAST, edges: DataFrame | None = None) -> DataFrame:
    """Ranks of nodes for sets of seeds (seed_set, id): seed_set, id, rank; nodes without rank have no row.

    Edges are those of a confidence of at least a half, each pair of nodes once, none from a node to itself. A set's ranks
    come within its mass left at the end of the exact ones, at most ``least`` a node reached. Seeds that the graph
    doesn't have keep their mass among them; repeated and null seeds count once and not at all; no seeds give no rows.
    """
    pairs = (g.edges if edges is None else edges).where("confidence >= 0.5 AND source_id <> target_id").select("source_id", "target_id").distinct()
    degree = pairs.groupBy("source_id").agg(F.count(F.lit(1)).alias("out"))
    pairs = stored(pairs.join(degree, "source_id"), "push-edges")
    degree = stored(degree, "push-degrees")
    seeds = seeds.select("seed_set", F.col("id").cast("long").alias("id")).where("seed_set IS NOT NULL AND id IS NOT NULL").distinct()
    share = seeds.groupBy("seed_set").agg((1.0 / F.count(F.lit(1))).alias("share"))
    start = stored(seeds.join(share, "seed_set"), "push-seeds")
    left = stored(start.select("seed_set", "id", F.col("share").alias("mass")), "push-mass")
    kept: list[DataFrame] = []
    while True:
        front = left.where(F.col("mass") > least)
        if front.isEmpty():
            break
        kept.append(front.select("seed_set", "id", ((1 - alpha) * F.col("mass")).alias("rank")))
        if len(kept) > MERGED:
            kept = [stored(_summed(kept), "push-ranks")]
        # mass without a way out, a row a set
        stuck = front.join(degree, F.col("id") == F.col("source_id"), "left_anti").groupBy("seed_set").agg(F.sum("mass").alias("stuck"))
        moved = front.join(pairs, F.col("id") == F.col("source_id")).select("seed_set", F.col("target_id").alias("id"), (alpha * F.col("mass") / F.col("out")).alias("mass"))
        back = start.join(stuck, "seed_set").select("seed_set", "id", (alpha * F.col("stuck") * F.col("share")).alias("mass"))
        rest = left.where(F.col("mass") <= least)
        left = stored(rest.unionByName(moved).unionByName(back).groupBy("seed_set", "id").agg(F.sum("mass").alias("mass")), "push-mass")
    # of what is left a node has its own part, as if it pushed once more
    kept.append(left.select("seed_set", "id", ((1 - alpha) * F.col("mass")).alias("rank")))
    return _summed(kept)


def _summed(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("seed_set", "id").agg(F.sum("rank").alias("rank"))


def file_ranks(g: Graph, ranks: DataFrame) -> DataFrame:
    """Ranks of files: the sum over their nodes, by set of seeds."""
    return ranks.join(g.nodes.select("id", "file_path"), "id").groupBy("seed_set", "file_path").agg(F.sum("rank").alias("rank"))
