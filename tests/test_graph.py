"""Walks over a graph of a few nodes with known answers."""

import pytest
from pyspark.sql import functions as F

from symloom.operators import lookups, resolution, traversal
from symloom.sources.graph import Graph, from_tables

NODES = [(1, "Function", "parse_expr", "src/parser.py", 10, 30, True, False), (2, "Function", "parse_stmt", "src/parser.py", 35, 55, True, False), (3, "Class", "Token", "src/tokens.py", 1, 20, True, False), (4, "Function", "tokenize", "src/tokens.py", 22, 40, True, False), (5, "Class", "Node", "src/ast.py", 1, 15, True, False), (6, "Class", "ASTBuilder", "src/ast.py", 20, 80, True, False), (7, "Function", "test_parse", "tests/test_p.py", 1, 20, False, True)]
EDGES = [(1, 4, "import", 1.0, 15), (1, 3, "name_match", 0.9, 20), (6, 1, "import", 1.0, 25), (6, 5, "same_file", 1.0, 30)]


@pytest.fixture()
def tiny(spark):
    g = Graph(spark, "")
    nodes = spark.createDataFrame(NODES, "id long, label string, name string, file_path string, start_line int, end_line int, is_exported boolean, is_test boolean")
    nodes = nodes.select("*", F.lit(None).cast("long").alias("parent_id"), F.concat("name", F.lit("()")).alias("signature"), F.col("name").alias("qualified_name"))
    files = nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"))
    edges = spark.createDataFrame(EDGES, "source_id long, target_id long, resolution_method string, confidence double, source_line int").withColumn("type", F.lit("CALLS")).join(files, "source_id")
    g.__dict__.update(nodes=nodes, edges=edges, sparse_edges=edges)
    return g


def seed(spark, path):
    return spark.createDataFrame([(path,)], "file_path string")


def test_reach(spark, tiny):
    got = {r["file_path"]: (r["score"], r["length"]) for r in traversal.reach(tiny, seed(spark, "src/ast.py")).collect()}
    assert got == {"src/parser.py": (0.5, 1), "src/tokens.py": (round(1.9 / 3, 6), 2)}


def test_breadth_first(spark, tiny):
    got = {r["file_path"]: r["distance"] for r in traversal.bfs_files(tiny, seed(spark, "src/ast.py")).collect()}
    assert got == {"src/ast.py": 0, "src/parser.py": 1, "src/tokens.py": 2}


def test_dead_code(tiny):
    assert {r["name"] for r in lookups.dead_code(tiny).collect()} == {"parse_stmt", "ASTBuilder"}


def test_pagerank_keeps_its_mass(spark, tiny):
    total = traversal.personalized_pagerank(tiny, seed(spark, "src/ast.py"), 10).agg(F.sum("rank")).first()[0]
    assert abs(total - 1) < 1e-4


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in resolution.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_edge_ids_follow_the_order(spark, sf_dir):
    e = from_tables(spark, sf_dir).numbered_edges.orderBy("source_id", "target_id", "type").select("id").toPandas()["id"]
    assert (e.to_numpy() == range(1, len(e) + 1)).all()
