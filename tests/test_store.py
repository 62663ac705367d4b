"""Stored tables, resolution on small graphs, and the query surface."""

import pytest
from pyspark.sql import functions as F

from symloom.engine import Engine, route
from symloom.operators import resolver as rv
from symloom.operators import store as st
from symloom.sources.graph import from_tables


def test_tables_are_created_filled_and_replaced(spark, tmp_path):
    path = str(tmp_path / "db")
    st.create(spark, path)
    st.create(spark, path)
    assert st.read(spark, path, "nodes").count() == 0
    rows = spark.createDataFrame([(1, "f", "a.py"), (2, "g", "b.py")], "id long, name string, file_path string")
    st.append(rows, path, "nodes")
    st.append(spark.createDataFrame([(1, 2, "CALLS", "a.py"), (2, 1, "CALLS", "b.py")], "source_id long, target_id long, type string, source_file string"), path, "edges")
    assert st.check_columns(st.read(spark, path, "nodes"), "nodes") == [] and "label" in st.check_columns(rows, "nodes")
    tables = {n: st.read(spark, path, n) for n in ("nodes", "edges", "properties", "assertions")}
    kept = st.without_files(tables, spark.createDataFrame([("b.py",)], "file_path string"))
    assert kept["edges"].count() == 0
    st.replace(kept["nodes"], path, "nodes")
    assert [r["name"] for r in st.read(spark, path, "nodes").collect()] == ["f"]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    st.append_json(spark.createDataFrame([(1, "a")], "id long, kind string"), path)
    st.append_json(spark.createDataFrame([(2, "b")], "id long, kind string"), path)
    (tmp_path / "log" / "bad.json").write_text('{"id": \n')
    assert sorted(r["id"] for r in st.read_json(spark, path, "id long, kind string").collect()) == [1, 2]


NODES = [
    (1, "Function", "main", "app/main.py", None), (2, "Function", "helper", "app/main.py", None), (3, "Function", "helper", "lib/util.py", None), (4, "Class", "Token", "lib/token.py", None),
    (5, "Method", "parse", "lib/token.py", 4), (6, "Class", "Other", "lib/other.py", None), (7, "Method", "parse", "lib/other.py", 6), (8, "Function", "unique", "x/y.py", None),
    (9, "Function", "twice", "x/a.py", None), (10, "Function", "twice", "x/b.py", None), (11, "Method", "only", "lib/other.py", 6), (12, "Function", "inner", "pkg/core.py", None), (13, "Function", "plain", "pkg/core.py", None),
]
IMPORTS = [("app/main.py", "Token", "lib.token"), ("app/main.py", "util", "lib"), ("app/main.py", "inner", "pkg"), ("pkg/__init__.py", "inner", ".core"), ("z/z.py", "helper", "lib.util")]
CALLS = [
    ("helper", "helper", 1, 2, "same_file", 1.0), ("parse", "t.parse", 2, 5, "import", 0.95), ("helper", "util.helper", 3, 2, "same_file", 1.0), ("unique", "unique", 4, 8, "verified_unique", 0.95),
    ("twice", "twice", 5, 9, "name_match", 0.6), ("only", "o.only", 6, 11, "import", 0.85), ("inner", "inner", 7, 12, "import", 1.0), ("gone", "gone", 8, None, None, None),
]


def tables(spark):
    nodes = spark.createDataFrame([*NODES, (20, "Function", "_", "pkg/__init__.py", None), (21, "Function", "zz", "z/z.py", None)], "id long, label string, name string, file_path string, parent_id long")
    index = rv.through_reexports(rv.import_index(spark.createDataFrame(IMPORTS, "file_path string, imported_name string, module_path string"), rv.aliases(nodes)), nodes)
    return nodes, index


def test_cascade(spark):
    nodes, index = tables(spark)
    calls = spark.createDataFrame([("app/main.py", 1, n, q, line) for n, q, line, *_ in CALLS] + [("z/z.py", 21, "helper", "helper", 1), ("z/z.py", 21, "parse", "Other.parse", 2)], "file_path string, caller_id long, callee_name string, callee_qualified string, line int")
    got = {(r["source_id"], r["target_id"]): (r["resolution_method"], r["confidence"], r["source_line"]) for r in rv.resolve(calls, nodes, index).collect()}
    want = {(1, t): (m, c, min(line for *_, line, t2, _, _ in CALLS if t2 == t)) for _, _, line, t, m, c in CALLS if t}
    want[21, 3], want[21, 7] = ("import", 1.0, 1), ("type_flow", 0.9, 2)
    assert got == want


def test_names_follow_reexports(spark):
    nodes, index = tables(spark)
    assert ("app/main.py", "inner", "pkg/core.py") in {tuple(r) for r in index.collect()}


@pytest.mark.parametrize("path, module, want", [("a/b/c.py", ".x", "a/b/x"), ("a/b/c.py", "..x.y", "a/x/y"), ("a/b/c.ts", "./x", "a/b/x"), ("a/b/c.ts", "../../x", "x"), ("a/b/c.py", "x.y", "x.y")])
def test_relative_modules(spark, path, module, want):
    assert spark.range(1).select(rv.absolute_module(F.lit(path), F.lit(module)).alias("m")).first()["m"] == want


def test_relationships(spark):
    nodes = spark.createDataFrame([(1, "Class", "Base", "a.py", 1), (2, "Class", "Sub", "a.py", 5), (3, "Function", "view", "a.py", 9), (4, "Class", "Base", "b.py", 1)], "id long, label string, name string, file_path string, start_line int")
    rows = spark.createDataFrame([("a.py", "python", 5, "class Sub(Base):", 0), ("a.py", "python", 8, "@app.get('/x')", 0), ("a.py", "python", 9, "def view():", 0), ("a.py", "python", 12, "def other():", 0)], "file_path string, language string, line int, text string, indent int")
    got = {(r["source_id"], r["target_id"], r["type"]) for r in rv.relationships(rows, nodes).collect()}
    assert got == {(2, 1, "EXTENDS"), (3, 1, "HANDLES_ROUTE")}


@pytest.mark.parametrize("question, name", [("What breaks if I change it?", "impact"), ("trace the calls", "trace"), ("any dead code?", "dead_code"), ("where is the bug", "find_relevant"), ("hm", "find_relevant")])
def test_routes(question, name):
    assert route(question) == name


def test_engine(spark, sf_dir):
    e = Engine(from_tables(spark, sf_dir))
    assert e.find_relevant("small red plate").count() > 0 and e.trace("red_plate").count() >= 0 and e.status().count() > 0
    diff = spark.createDataFrame([(1, "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-def red_plate(a):\n+def red_plate(a, b):\n")], "diff_id long, diff string")
    assert e.review(diff).where("kind <> 'changed_signature'").count() == 0


def test_chains_of_reexports(spark):
    """Three hops resolve as an import, by name or by everything; cycles stop; a fourth hop isn't taken."""
    files = ["app.py", "a/__init__.py", "b/__init__.py", "c/__init__.py", "d/core.py", "e/core.py"]
    nodes = spark.createDataFrame([(i, "Function", f"own{i}", f, None) for i, f in enumerate(files)] + [(50, "Function", "deep", "d/core.py", None), (51, "Function", "deep", "zzz.py", None), (60, "Function", "far", "e/core.py", None), (61, "Function", "far", "zzz.py", None)], "id long, label string, name string, file_path string, parent_id long")
    links = [("app.py", "deep", files[1]), (files[1], "deep", files[2]), (files[2], "*", files[3]), (files[3], "deep", files[4]), (files[3], "deep", files[1]), ("app.py", "far", files[1]), (files[1], "far", files[2]), (files[2], "far", files[3]), (files[3], "far", files[4]), (files[4], "far", files[5])]
    index = spark.createDataFrame(links, "file_path string, imported_name string, target_file string")
    calls = spark.createDataFrame([("app.py", 0, "deep", "deep", 3), ("app.py", 0, "far", "far", 4)], "file_path string, caller_id long, callee_name string, callee_qualified string, line int")
    got = {(r["target_id"], r["resolution_method"], r["confidence"]) for r in rv.resolve(calls, nodes, index).collect()}
    assert got == {(50, "import", 1.0), (60, "name_match", 0.6)}


def test_a_caller_is_no_candidate(spark):
    nodes = spark.createDataFrame([(1, "Function", "f", "a.py", None), (2, "Function", "f", "b.py", None), (3, "Function", "f", "b.py", None), (9, "Function", "g", "b.py", None)], "id long, label string, name string, file_path string, parent_id long")
    none = spark.createDataFrame([], "file_path string, imported_name string, target_file string")
    calls = spark.createDataFrame([("a.py", 1, "f", "f", 1), ("b.py", 9, "f", "f", 2), ("b.py", 9, "g", "g", 3), ("b.py", 9, None, None, 4)], "file_path string, caller_id long, callee_name string, callee_qualified string, line int")
    got = {(r["source_id"], r["target_id"], r["candidate_count"]) for r in rv.resolve(calls, nodes, none).collect()}
    assert got == {(1, 2, 2), (9, 1, 3)}
