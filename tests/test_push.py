"""Node ranks by pushing against power iteration over the whole graph."""

import random

import numpy as np
import pytest

from symloom.operators import push
from symloom.sources.graph import from_tables

EDGES = "source_id BIGINT, target_id BIGINT, confidence DOUBLE"


def exact(edges, seeds, alpha=0.85):
    out, nodes = {}, set(seeds)
    for a, b, c in edges:
        if c >= 0.5 and a != b:
            out.setdefault(a, set()).add(b)
            nodes |= {a, b}
    at = {n: i for i, n in enumerate(sorted(nodes))}
    start = np.zeros(len(at))
    start[[at[s] for s in seeds]] = 1 / len(seeds)
    rank = start.copy()
    for _ in range(300):
        new = (1 - alpha) * start
        for n, i in at.items():
            if n in out:
                for m in out[n]:
                    new[at[m]] += alpha * rank[i] / len(out[n])
            else:
                new = new + alpha * rank[i] * start
        rank = new
    return {n: rank[i] for n, i in at.items()}


def check(spark, edges, sets, g=None):
    df = spark.createDataFrame(edges, EDGES)
    seeds = spark.createDataFrame([(s, n) for s, ns in sets.items() for n in ns] + [(next(iter(sets)), None), (None, 1)], "seed_set STRING, id BIGINT")
    got = {}
    for r in push.node_ranks(g, seeds.union(seeds), edges=df).collect():
        got.setdefault(r["seed_set"], {})[r["id"]] = r["rank"]
    for s, ns in sets.items():
        theirs = exact(edges, ns)
        assert abs(sum(got[s].values()) - 1) < 1e-4
        assert all(abs(got[s].get(n, 0.0) - x) < 1e-4 for n, x in theirs.items()) and set(got[s]) <= set(theirs)


@pytest.mark.parametrize("seed", range(1))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(1, 30), r.randint(1, 40), r.choice([0.2, 0.5, 1.0])) for _ in range(120)]
    check(spark, edges + edges[:20], {"a": [1, 2], "b": [35], "c": [99], "d": list(range(1, 20))})


def test_cycle_and_dangling(spark):
    check(spark, [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (4, 4, 1.0)], {"x": [1], "y": [4], "z": [3, 1]})


def test_whole_graph(spark, sf_dir):
    g = from_tables(spark, sf_dir)
    edges = [(r["source_id"], r["target_id"], r["confidence"]) for r in g.edges.select("source_id", "target_id", "confidence").collect()]
    seeds = spark.createDataFrame([("s", 3), ("s", 7), ("t", 11)], "seed_set STRING, id BIGINT")
    rows = push.node_ranks(g, seeds)
    got = {(r["seed_set"], r["id"]): r["rank"] for r in rows.collect()}
    for s, ns in (("s", [3, 7]), ("t", [11])):
        assert all(abs(got.get((s, n), 0.0) - x) < 1e-4 for n, x in exact(edges, ns).items())
    files = push.file_ranks(g, rows)
    assert abs(sum(r["rank"] for r in files.where("seed_set = 's'").collect()) - 1) < 1e-3


def test_no_seeds(spark, sf_dir):
    assert push.node_ranks(from_tables(spark, sf_dir), spark.createDataFrame([], "seed_set STRING, id BIGINT")).count() == 0
