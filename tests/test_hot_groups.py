"""Groups of which all pairs would be too many: nodes of one name in two files, each of which calls and imports the next."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.operators import checks, lookups, mining, resolution, resolver, symbols
from symloom.sources import graph
from symloom.sources.graph import Graph

N = 100_000


@pytest.fixture(scope="module")
def ring(spark):
    g = Graph(spark, "/nowhere")
    path = lambda i: F.when(i % 2 == 1, "src/a.py").otherwise("src/b.py")
    i = F.col("id")
    g.__dict__["nodes"] = spark.range(1, N + 1).select("id", F.lit("Function").alias("label"), F.lit("f").alias("name"), F.lit("m.f").alias("qualified_name"), path(i).alias("file_path"), F.lit(True).alias("is_exported"), F.lit(None).cast("long").alias("parent_id"))
    edge = spark.range(1, N + 1).select(i.alias("source_id"), (i % N + 1).alias("target_id"), path(i).alias("source_file"), F.lit(1).alias("source_line"), F.lit(1.0).alias("confidence"))
    g.__dict__["edges"] = g.__dict__["_plain_edges"] = edge.withColumn("type", F.explode(F.array(F.lit("CALLS"), F.lit("IMPORTS"))))
    return g


def counted(df, *columns):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*columns).count().collect()}


def test_broken_callers_are_counted_by_name(spark, ring):
    diff = "--- a/src/a.py\n+++ b/src/a.py\n@@ -1,2 +1,2 @@\n-def f(a):\n+def f(a, b):\n-def gone():\n"
    diffs = spark.range(20_000).select(F.col("id").alias("diff_id"), F.lit(diff).alias("diff"))
    counts = checks.broken_caller_counts(ring, checks.diff_lines(diffs))
    assert counted(counts, "status", "callers") == {("changed", N): 20_000}
    two = Graph(spark, "/nowhere")
    two.__dict__["nodes"] = spark.createDataFrame([(1, "f"), (2, "g"), (3, "h")], "id long, name string")
    two.__dict__["edges"] = spark.createDataFrame([(3, 1, "CALLS"), (3, 2, "CALLS"), (1, 2, "CALLS"), (2, 1, "USES")], "source_id long, target_id long, type string")
    both = spark.createDataFrame([(1, "+++ b/x.py\n@@ -1 +1 @@\n-def f():\n-def g():\n"), (2, "+++ b/x.py\n@@ -1 +1 @@\n-def f():\n")], "diff_id long, diff string")
    assert sorted(tuple(r) for r in checks.broken_caller_counts(two, checks.diff_lines(both)).collect()) == [(1, "removed", 2), (2, "removed", 1)]
    pairs = checks.broken_callers(two, checks.diff_lines(both)).groupBy("diff_id", "status").agg(F.countDistinct("caller_id")).collect()
    assert sorted(tuple(r) for r in pairs) == [(1, "removed", 2), (2, "removed", 1)]


def test_import_dependents_are_counted_by_file(ring):
    assert counted(symbols.import_dependent_counts(ring), "dependents", "first_id") == {(N // 2, 1): N // 2, (N // 2, 2): N // 2}


def test_calls_meet_one_row_a_step(ring):
    found = resolution.resolve_calls(ring)
    assert counted(found, "target_id", "method") == {(1, "same_file"): N // 2, (2, "same_file"): N // 2}


def test_cascade_meets_one_row_a_step(spark, ring):
    calls = ring.nodes.select("file_path", F.col("id").alias("caller_id"), F.col("name").alias("callee_name"), F.lit("f").alias("callee_qualified"), F.lit(1).alias("line"))
    files = spark.range(2000).select(F.lit("src/a.py").alias("file_path"), F.lit("*").alias("imported_name"), F.concat(F.lit("lib/"), F.col("id").cast("string")).alias("target_file"))
    more = files.select((F.row_number().over(Window.orderBy("target_file")) + N).cast("long").alias("id"), F.lit("Function").alias("label"), F.lit("f").alias("name"), F.lit("m.f").alias("qualified_name"), F.col("target_file").alias("file_path"), F.lit(True).alias("is_exported"), F.lit(None).cast("long").alias("parent_id"))
    got = resolver.resolve(calls, ring.nodes.unionByName(more), files)
    # calls in a find the first of the imported files, those in b any node of the name but themselves
    assert counted(got, "target_id", "resolution_method") == {(N + 1, "import"): N // 2, (1, "name_match"): N // 2}


def test_siblings_are_counted_by_group(ring):
    one = {(N // 2 - 1, f): N // 2 - 1 for f in (1, 2)} | {(N // 2 - 1, f): 1 for f in (3, 4)}
    assert counted(lookups.first_siblings(ring), "n", "first_id") == one


def test_classes_are_found_once_a_name(spark):
    nodes = spark.range(1, N + 1).select("id", F.lit("Class").alias("label"), F.lit("f").alias("name"), F.concat(F.lit("src/"), F.col("id").cast("string")).alias("file_path"))
    wanted = nodes.select(F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(F.concat(F.lit("x/"), "file_path")).alias("file_path"), "name")
    got = resolver.class_named(wanted, nodes)
    assert counted(got.select((F.col("node_id") == F.regexp_extract("file_path", r"(\d+)$", 1).cast("long")).alias("own"), (F.col("node_id") == 1).alias("first")), "own", "first") == {(True, False): N // 2, (False, True): N // 2 - 1, (True, True): 1}


def test_many_nodes_are_dealt_and_never_broadcast(spark, sf_dir, monkeypatch):
    few = sorted(tuple(r) for r in mining.sibling_outliers(Graph(spark, sf_dir)).collect())
    monkeypatch.setattr(graph, "NODES_PER_TASK", 50, raising=False)
    many = Graph(spark, sf_dir)
    assert many.nodes.rdd.getNumPartitions() > 1
    # by its file's size alone the planner would broadcast it, however many rows the file has
    joined = many.properties.join(many.nodes.select(F.col("id").alias("node_id"), "name"), "node_id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert sorted(tuple(r) for r in mining.sibling_outliers(many).collect()) == few


def test_many_lines_are_dealt_to_tasks_by_their_number(spark, sf_dir, monkeypatch):
    few = Graph(spark, sf_dir)
    monkeypatch.setattr(graph, "LINES_PER_TASK", 300, raising=False)
    many = Graph(spark, sf_dir)
    assert many.edges.rdd.getNumPartitions() == many.commit_files.rdd.getNumPartitions() == -(-many.table("lineitem").count() // 300) > 8
    for name in ("edges", "commit_files"):
        a, b = getattr(few, name), getattr(many, name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_enclosing_meets_no_pairs_of_a_file(spark):
    import random

    draw = random.Random(1)
    nodes = [(i, "Function", f"f{i % 3}", s, s + draw.choice([-1, 0, 3, 7, 8, 9, 63, 64, 65, 700])) for i in range(300) for s in [draw.randrange(1, 900)]]
    points = [(p, f"f{draw.randrange(4)}", draw.randrange(1, 1000)) for p in range(200)] + [(7, "f1", 5), (500, "f0", None), (None, "f0", 8)]
    g = Graph(spark, "/nowhere")
    g.__dict__["nodes"] = spark.createDataFrame(nodes, "id long, label string, file_path string, start_line int, end_line int")
    best = {}
    for p, f, line in points:
        inner = [(e - s, i) for i, _, path, s, e in nodes if path == f and line is not None and s <= line <= e]
        best[p] = min(inner + ([best[p]] if p in best else []), default=None)
    got = lookups.enclosing(g, spark.createDataFrame(points, "point_id long, file_path string, line int")).collect()
    assert {r[0]: r[1] for r in got} == {p: b[1] for p, b in best.items() if b}
    # a file of as many nodes as points: 10^10 pairs
    hot = spark.range(N).select("id", F.lit("Function").alias("label"), F.lit("f").alias("file_path"), (F.col("id") % 97 + 1).cast("int").alias("start_line"), (F.col("id") % 97 + 20).cast("int").alias("end_line"))
    g.__dict__["nodes"] = hot
    found = lookups.enclosing(g, hot.select(F.col("id").alias("point_id"), "file_path", F.col("start_line").alias("line")))
    assert found.where("node_id < 97").count() == N


def test_budget_is_spent_without_python(spark):
    import random

    draw = random.Random(2)
    rows = [(t, f"k{draw.randrange(4)}", draw.choice([0.5, 0.7, 0.9]), draw.choice([0, 50, 100, 200, 449, 451])) for t in range(40) for _ in range(draw.randrange(1, 9))]
    want = []
    for t in range(40):
        left, many = 450, {}
        for _, k, s, n in sorted((r for r in rows if r[0] == t), key=lambda r: (-r[2], r[3])):
            many.setdefault(k, []).append((s, n))
        for s, k, n in sorted(((s, k, n) for k, each in many.items() for s, n in each[:2]), key=lambda r: (-r[0], r[1], r[2])):
            if n <= left:
                left -= n
                want.append((t, k, s, n))
    chosen = mining.select_within_budget(spark.createDataFrame(rows, "target long, family string, score double, tokens long"))
    assert sorted(tuple(r) for r in chosen.collect()) == sorted(want)
    assert "Pandas" not in chosen._jdf.queryExecution().sparkPlan().toString()


def test_serialization_pairs_come_once_without_a_distinct(spark):
    names = ["to_x", "from_x", "encode_to_x", "decode_from_x", "decode_to_x", "encode_from_x", "to_from_x", "from_to_x", "ab", "ba", "aab", "bab", "b", "a", "aba"]
    parts = [("to_", "from_"), ("encode", "decode"), ("a", "b"), ("b", "a")]
    nodes = spark.createDataFrame([(i, "Function", n, "f", None) for i, n in enumerate(names)], "id long, label string, name string, file_path string, parent_id long")
    want = {(i, j) for i, x in enumerate(names) for j, y in enumerate(names) for a, b in parts + [(b, a) for a, b in parts] if a in x and b in y and x.replace(a, "*") == y.replace(b, "*")}
    found = resolver.serialization_pairs(nodes, parts)
    assert sorted(tuple(r) for r in found.select("id", "other_id").collect()) == sorted(want)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
