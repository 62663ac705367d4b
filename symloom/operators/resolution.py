"""Resolution of calls, derived relations and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import api_path, directory
from ..sources.graph import Graph


def name_match_confidence(n: F.Column) -> F.Column:
    """Confidence of a match by name alone, by the number of candidates."""
    return F.when(n <= 1, 0.9).when(n == 2, 0.6).when(n <= 5, 0.4).otherwise(0.2)


def resolve_calls(g: Graph, edges: DataFrame | None = None) -> DataFrame:
    """Calls by qualified name resolved anew: the same file's node first, then a file's that the caller imports, then by
    name alone. Candidates of the first step that has any; the smallest id wins.

    Candidates are counted once for each file that calls a name, by files, and a call meets at most one row a step."""
    q = g.nodes.select("id", "qualified_name", "file_path")
    calls = (g.edges if edges is None else edges).where("type = 'CALLS'").join(q.select(F.col("id").alias("target_id"), "qualified_name"), "target_id").select("source_id", "source_file", "qualified_name").distinct()
    by_file = q.groupBy("qualified_name", "file_path").agg(F.min("id").alias("target_id"), F.count(F.lit(1)).alias("candidates"))
    ends = q.select(F.col("id").alias("target_id"), F.col("file_path").alias("imported_file"))
    imports = g.edges.where("type = 'IMPORTS'").join(ends, "target_id").select("source_file", "imported_file").distinct()
    found = calls.select("source_file", "qualified_name").distinct().join(by_file, "qualified_name")
    step = F.when(F.col("file_path") == F.col("source_file"), 1).when(F.col("imported_file").isNotNull(), 2).otherwise(3)
    found = found.join(imports.withColumnRenamed("source_file", "_s"), (F.col("source_file") == F.col("_s")) & (F.col("file_path") == F.col("imported_file")), "left").withColumn("step", step)
    steps = found.groupBy("source_file", "qualified_name", "step").agg(F.min("target_id").alias("target_id"), F.sum("candidates").alias("candidates"))
    per = calls.join(steps, ["source_file", "qualified_name"]).groupBy("source_id", "qualified_name", "step").agg(F.min("target_id").alias("target_id"), F.sum("candidates").alias("candidates"))
    best = per.groupBy("source_id", "qualified_name").agg(F.min_by(F.struct("step", "target_id", "candidates"), "step").alias("b"))
    return best.select("source_id", "qualified_name", F.col("b.target_id").alias("target_id"), F.element_at(F.array(F.lit("same_file"), F.lit("import"), F.lit("name_match")), F.col("b.step")).alias("method"), F.when(F.col("b.step") < 3, 1.0).otherwise(name_match_confidence(F.col("b.candidates"))).alias("confidence"))


def homonyms(g: Graph) -> DataFrame:
    """Nodes of each name with the confidence that a match by name alone has."""
    n = g.nodes.groupBy("name").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("file_path").alias("files"), F.min("id").alias("first_id"))
    return n.select("name", "candidates", "files", "first_id", name_match_confidence(F.col("candidates")).alias("confidence"))


def module_aliases(g: Graph) -> DataFrame:
    """Dotted suffixes of files' paths with the number of files that they stand for."""
    parts = F.split(F.regexp_replace("file_path", r"\.[a-z]+$", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, 99), "."))
    return g.nodes.select("file_path").distinct().select(F.explode(tails).alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("files"))


def assertion_targets(g: Graph) -> DataFrame:
    """For each assertion the callee of its test with the most evidence: name in the expression 3, same file 4, not a test .5."""
    c = g.edges.where("type = 'CALLS'").select(F.col("source_id").alias("test_node_id"), F.col("target_id").alias("candidate"), "source_file").distinct()
    n = g.nodes.select(F.col("id").alias("candidate"), "name", F.col("file_path").alias("candidate_file"), "is_test")
    j = g.assertions.select(F.col("id").alias("assertion_id"), "test_node_id", "expression").join(c, "test_node_id").join(n, "candidate")
    score = F.when(F.contains("expression", F.concat(F.lit("("), "name", F.lit("("))), 3.0).otherwise(0.0) + F.when(F.col("candidate_file") == F.col("source_file"), 4.0).otherwise(0.0) + F.when(~F.col("is_test"), 0.5).otherwise(0.0)
    order = Window.partitionBy("assertion_id").orderBy(F.desc("score"), "candidate")
    return j.withColumn("score", score).withColumn("_k", F.row_number().over(order)).where("_k = 1 AND score >= 3.5").select("assertion_id", "candidate", "score")


def proximity(g: Graph) -> DataFrame:
    """For each name and folder the node of that name in the folder, else of the smallest id."""
    n = g.nodes.select("name", "id", directory(F.col("file_path")).alias("dir"))
    here = n.groupBy("name", "dir").agg(F.min("id").alias("here"))
    anywhere = n.groupBy("name").agg(F.min("id").alias("anywhere"))
    return here.join(anywhere, "name").select("name", "dir", "here", "anywhere")


def structural_twins(g: Graph) -> DataFrame:
    """Pairs of functions of one file whose names share all but the first part."""
    n = g.nodes.where("label IN ('Function', 'Method')").select("file_path", "name", F.split("name", "_")[0].alias("head"), F.regexp_replace("name", "^[^_]*_", "").alias("tail")).where("head <> name").distinct()
    return n.alias("a").join(n.alias("b"), (F.col("a.file_path") == F.col("b.file_path")) & (F.col("a.tail") == F.col("b.tail"))).where("a.head < b.head").select(F.col("a.file_path").alias("file_path"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))


def api_paths(g: Graph) -> DataFrame:
    """Normal forms of pages' paths and how many have them."""
    return g.table("pages").select(api_path(F.col("url")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def route_matches(g: Graph) -> DataFrame:
    """Clients (even pages) and routes (odd pages) with the same normal path: how many of each."""
    p = g.table("pages").select("page_id", api_path(F.col("url")).alias("path"))
    sides = p.groupBy("path").agg(F.count_if(F.col("page_id") % 2 == 0).alias("clients"), F.count_if(F.col("page_id") % 2 == 1).alias("routes"))
    return sides.where("clients > 0 AND routes > 0")


def replace_file(g: Graph, path: str) -> DataFrame:
    """Rows that an update of one file deletes, by table."""
    ids = g.nodes.where(F.col("file_path") == path).select("id")
    e = g.edges.join(ids, F.col("target_id") == F.col("id"), "left").where((F.col("source_file") == path) | F.col("id").isNotNull())
    p = g.properties.join(ids, F.col("node_id") == ids["id"], "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
    return count(e, "edges").unionByName(count(p, "properties")).unionByName(count(ids, "nodes"))


def restore_incoming(g: Graph, path: str) -> DataFrame:
    """Edges from other files into one file, bound anew by name: confidence kept with one candidate, else by their number."""
    mine = g.nodes.where(F.col("file_path") == path).select("id", "name")
    n = mine.groupBy("name").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("new_target"))
    e = g.edges.where(F.col("source_file") != path).join(mine, F.col("target_id") == F.col("id")).join(n, "name")
    return e.select("source_id", "type", F.col("target_id").alias("old_target"), "new_target", F.when(F.col("candidates") == 1, F.col("confidence")).otherwise(name_match_confidence(F.col("candidates"))).alias("confidence"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, changed, unchanged or deleted for each path of two tables (file_path, hash)."""
    j = old.select("file_path", F.col("hash").alias("old")).join(new.select("file_path", F.col("hash").alias("new")), "file_path", "full")
    return j.select("file_path", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed").alias("status"))


def freshness(g: Graph) -> DataFrame:
    """How old the last call of each run is at the last call of all."""
    last = g.interventions.agg(F.max("ts").alias("now"))
    runs = g.interventions.groupBy("run_id").agg(F.max("ts").alias("ts")).crossJoin(F.broadcast(last))  # one row
    age = F.unix_timestamp("now") - F.unix_timestamp("ts")
    return runs.select("run_id", F.when(age <= 60, "FRESH").when(age <= 3600, "SLIGHTLY_STALE").otherwise("STALE").alias("freshness"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of the rows of ``old`` with its keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
