"""Operators see every edge of a graph, not the fixture's thinned ones."""

from pyspark.sql import functions as F

from symloom.operators import lookups, mining, resolution, traversal
from symloom.sources.graph import from_parquet

FILES = ["src/a/m.py", "src/b/n.py", "src/c/o.py", "tests/t.py"]
#: (source_id * 31 + target_id) % 37 is 0 for none of these.
CALLS = [(1, 2), (2, 3), (4, 1), (4, 3)]
IMPORTS = [(1, 3)]


def stored(spark, path):
    nodes = [(i + 1, "Function", f"f{i}", f"f{i}", f, i < 3, i == 3, None, f"f{i}()") for i, f in enumerate(FILES)]
    spark.createDataFrame(nodes, "id long, label string, name string, qualified_name string, file_path string, is_exported boolean, is_test boolean, parent_id long, signature string").write.parquet(f"{path}/nodes.parquet")
    rows = [(n + 1, a, b, kind, FILES[a - 1], 1.0) for n, (a, b, kind) in enumerate([(*e, "CALLS") for e in CALLS] + [(*e, "IMPORTS") for e in IMPORTS])]
    spark.createDataFrame(rows, "id long, source_id long, target_id long, type string, source_file string, confidence double").write.parquet(f"{path}/edges.parquet")
    for name in ("properties", "assertions", "commit_files", "interventions"):
        spark.range(0).write.parquet(f"{path}/{name}.parquet")
    return from_parquet(spark, str(path))


def test_operators_read_all_edges(spark, tmp_path):
    g = stored(spark, tmp_path)
    seed = spark.createDataFrame([(FILES[0],)], "file_path string")
    assert lookups.dead_code(g).count() == 0
    assert {(r["file_path"], r["indirect"]) for r in lookups.indirect_files(g).collect()} == {(FILES[2], FILES[0]), (FILES[1], FILES[3])}
    assert {tuple(r) for r in lookups.common_test_importers(g).collect()} == {(FILES[0], FILES[2], 1)}
    assert {r["source_id"] for r in resolution.resolve_calls(g).collect()} == {1, 2, 4} and resolution.resolve_calls(g).count() == len(CALLS)
    assert {tuple(r) for r in mining.moved_imports(g).collect()} == {(FILES[0], "f2", FILES[2])}
    assert {r["file_path"]: r["distance"] for r in traversal.bfs_files(g, seed).collect()} == dict(zip(FILES, (0, 1, 1, 1)))
    assert {r["file_path"] for r in traversal.relevance(g, seed).collect()} == set(FILES)
    assert {r["file_path"] for r in traversal.reach(g, seed).collect()} == set(FILES[1:3])
    assert {r["id"]: r["depth"] for r in traversal.callee_closure(g, spark.createDataFrame([(1,)], "id long")).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r["file_path"] for r in traversal.anchor_proximity(g, seed).collect()} == set(FILES[1:])
    assert traversal.personalized_pagerank(g, seed, 3, tolerance=None).where(F.col("rank") > 0).count() == 3
    assert traversal.weighted_pagerank(g, 3).agg(F.countDistinct("rank")).first()[0] == 4


def test_ranks_converge_as_by_brute_force(spark, tmp_path):
    g = stored(spark, tmp_path)
    index, edges = {f: i for i, f in enumerate(FILES)}, {(a - 1, b - 1) for a, b in CALLS + IMPORTS}
    weights = {e: sum(e == (a - 1, b - 1) for a, b in CALLS + IMPORTS) for e in edges}
    out, total = [sum(a == i for a, _ in edges) for i in range(4)], [sum(w for (a, _), w in weights.items() if a == i) for i in range(4)]
    own, even = [1.0, 0, 0, 0], [0.25] * 4
    for _ in range(30):
        lost = sum(r for i, r in enumerate(own) if not out[i])
        now = [0.15 * (i == 0) + 0.85 * (sum(own[a] / out[a] for a, b in edges if b == i) + lost * (i == 0)) for i in range(4)]
        moved, own = max(abs(x - y) for x, y in zip(own, now)), now
        if moved < 1e-4:
            break
    for _ in range(50):
        now = [0.15 * 0.25 + 0.85 * sum(even[a] * w / total[a] for (a, b), w in weights.items() if b == i) for i in range(4)]
        moved, even = sum(abs(x - y) for x, y in zip(even, now)), now
        if moved < 1e-6:
            break
    seed = spark.createDataFrame([(FILES[0],)], "file_path string")
    for got, want in ((traversal.personalized_pagerank(g, seed), own), (traversal.weighted_pagerank(g), even)):
        assert all(abs(r["rank"] - want[index[r["file_path"]]]) < 2e-6 for r in got.collect())
