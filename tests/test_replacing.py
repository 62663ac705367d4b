"""Versions of tables, and files replaced in them, against a plain rendering; changes that break off change nothing."""

import pytest

from symloom.operators import replacing
from symloom.sources.versions import Versions

NODES = "id BIGINT, label STRING, name STRING, file_path STRING, start_line INT"
EDGES = "id BIGINT, source_id BIGINT, target_id BIGINT, type STRING, source_line INT, source_file STRING, resolution_method STRING, confidence DOUBLE, trust_tier STRING, candidate_count INT"
FACTS = "id BIGINT, node_id BIGINT, kind STRING"


def graph(spark):
    nodes = [(1, "Function", "a", "x.py", 1), (2, "Function", "b", "x.py", 5), (3, "Function", "c", "y.py", 1), (4, "Function", "d", "z.py", 1), (5, "Function", None, "x.py", 9)]
    edges = [(1, 3, 1, "CALLS", 2, "y.py", "import", 0.3, "CERTIFIED", 1), (2, 4, 2, "CALLS", 3, "z.py", "name_match", 0.9, "CERTIFIED", 1), (3, 1, 3, "CALLS", 1, "x.py", "import", 1.0, "CERTIFIED", 1), (4, 1, 2, "CALLS", 1, "x.py", "same_file", 1.0, "CERTIFIED", 1), (5, 3, 4, "CALLS", 7, "y.py", "import", 1.0, "CERTIFIED", 1), (6, 4, 5, "CALLS", 8, None, "import", 1.0, "CERTIFIED", 1)]
    facts = [(1, 1, "guard"), (2, 3, "guard"), (3, 2, "doc")]
    return {"nodes": spark.createDataFrame(nodes, NODES), "edges": spark.createDataFrame(edges, EDGES), "properties": spark.createDataFrame(facts, FACTS)}


NEW = [("Function", "a", "x.py", 2), ("Function", "b2", "x.py", 6), ("Function", "e", "other.py", 1)]


@pytest.fixture
def store(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "graph"))
    replacing.create(v, graph(spark))
    return v


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def replaced(spark, v):
    files = spark.createDataFrame([("x.py",), ("x.py",), ("unknown.py",)], "file_path STRING")
    nodes = spark.createDataFrame(NEW, "label STRING, name STRING, file_path STRING, start_line INT")
    own = lambda new: new.where("name = 'a'").selectExpr("id AS source_id", "CAST(4 AS BIGINT) AS target_id", "'CALLS' AS type", "3 AS source_line", "file_path AS source_file", "'import' AS resolution_method", "1.0D AS confidence", "'CERTIFIED' AS trust_tier", "1 AS candidate_count")
    facts = {"properties": lambda new: new.selectExpr("id + 100 AS id", "id AS node_id", "'new' AS kind")}
    return replacing.replace_files(v, files, nodes, own, facts)


def test_replacing_a_file(spark, store):
    counts = replaced(spark, store)
    assert counts == {"nodes_deleted": 3, "nodes_inserted": 2, "edges_deleted": 5, "edges_restored": 1, "edges_dropped": 2, "edges_inserted": 1}
    v = Versions(spark, store.path)
    assert v.at == 2
    assert rows(v.read("nodes"), "id", "name", "file_path") == [(3, "c", "y.py"), (4, "d", "z.py"), (6, "a", "x.py"), (7, "b2", "x.py")]
    assert rows(v.read("edges"), "source_id", "target_id", "resolution_method", "confidence") == [(3, 4, "import", 1.0), (3, 6, "import", 1.0), (6, 4, "import", 1.0)]
    assert rows(v.read("properties"), "node_id", "kind") == [(3, "guard"), (6, "new"), (7, "new")]
    assert v.read("edges").select("id").distinct().count() == 3


def test_untouched_parts_stay(spark, store):
    before = {t: set(store.tables[t]["parts"].values()) for t in store.tables}
    replaced(spark, store)
    kept = set(store.tables["nodes"]["parts"].values()) & before["nodes"]
    assert len(before["nodes"]) - len(kept) == 1  # the file's own bucket


@pytest.mark.parametrize("where", ["rewrite", "commit"])
@pytest.mark.parametrize("nth", [1, 2])
def test_a_change_that_breaks_off_changes_nothing(spark, store, monkeypatch, where, nth):
    before = {t: rows(store.read(t), *store.read(t).columns) if t != "nodes" else store.read(t).count() for t in ("properties", "nodes")}
    whole, calls = getattr(Versions, where), []

    def broken(self, *a):
        calls.append(1)
        if len(calls) == nth or where == "commit":
            raise OSError("lost")
        return whole(self, *a)

    monkeypatch.setattr(Versions, where, broken)
    with pytest.raises(OSError):
        replaced(spark, store)
    monkeypatch.undo()
    v = Versions(spark, store.path)
    assert v.at == 1 and v.read("nodes").count() == before["nodes"] and rows(v.read("properties"), *v.read("properties").columns) == before["properties"]
    assert replaced(spark, v)["edges_restored"] == 1


def test_two_changes_of_one_version(spark, store):
    other = Versions(spark, store.path)
    replaced(spark, store)
    with pytest.raises(RuntimeError):
        replaced(spark, other)
    assert replaced(spark, other.refresh())["nodes_deleted"] == 2


def test_nothing_to_replace(spark, store):
    none = spark.createDataFrame([], "file_path STRING")
    counts = replacing.replace_files(store, none, spark.createDataFrame(NEW, "label STRING, name STRING, file_path STRING, start_line INT"))
    assert set(counts.values()) == {0} and store.read("edges").count() == 6


@pytest.mark.parametrize(("n", "confidence", "tier"), [(1, 0.9, "CERTIFIED"), (2, 0.6, "CANDIDATE"), (5, 0.4, "SPECULATIVE"), (6, 0.2, "SPECULATIVE")])
def test_confidence_by_candidates(spark, n, confidence, tier):
    incoming = spark.createDataFrame([(9, 1, "CALLS", 1, "o.py", "name_match", 0.5, "x.py", "a")], "source_id BIGINT, target_id BIGINT, type STRING, source_line INT, source_file STRING, resolution_method STRING, confidence DOUBLE, target_file STRING, target_name STRING")
    nodes = spark.createDataFrame([(20 - i, "a", "x.py") for i in range(n)], "id BIGINT, name STRING, file_path STRING")
    (r,) = replacing.rebound(incoming, nodes).collect()
    assert (r["target_id"], r["confidence"], r["trust_tier"], r["candidate_count"], r["resolution_method"]) == (21 - n, confidence, tier, n, "name_match")
