"""Queries of resolution, relations and the stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inverted, replacing
from ..operators import resolver as rv
from ..operators import store as st
from ..sources.graph import Graph
from ..sources.versions import scratch
from .registry import add, add_both, sparse

FILE = "src/brand4/large.py"
MODULE = "replace(regexp_replace({}, '\\.py$', ''), '/', '.')"


def _module(path: str):
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def _calls(g: Graph, edges: DataFrame) -> DataFrame:
    """Calls of edges by name, of methods with their class before."""
    owner = g.nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("_owner"))
    t = g.nodes.join(owner, "parent_id", "left").select(F.col("id").alias("target_id"), "name", "_owner", "label")
    e = edges.where("type = 'CALLS'").join(t, "target_id")
    qualified = F.when((F.col("label") == "Method") & (F.col("target_id") % 2 == 0), F.concat("_owner", F.lit("."), "name")).otherwise(F.col("name"))
    return e.select(F.col("source_file").alias("file_path"), F.col("source_id").alias("caller_id"), F.col("name").alias("callee_name"), qualified.alias("callee_qualified"), F.col("source_line").alias("line"))


def _imports(g: Graph, edges: DataFrame) -> DataFrame:
    t = g.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("imported_name"), _module("file_path").alias("module_path"))
    e = edges.where("type = 'IMPORTS'").join(t, "target_id")
    return e.select(F.col("source_file").alias("file_path"), "source_line", F.when(F.col("target_id") % 10 == 0, "*").otherwise(F.col("imported_name")).alias("imported_name"), "module_path")


def _index(g: Graph, edges: DataFrame) -> DataFrame:
    return rv.import_index(_imports(g, edges), rv.aliases(g.nodes))


CALLS = "calls AS (SELECT DISTINCT e.source_file AS file_path, e.source_id AS caller_id, t.name AS callee_name, CASE WHEN t.label = 'Method' AND t.id % 2 = 0 THEN concat(o.name, '.', t.name) ELSE t.name END AS q, e.source_line AS line FROM sparse e JOIN nodes t ON t.id = e.target_id LEFT JOIN nodes o ON o.id = t.parent_id WHERE e.type = 'CALLS')"
INDEX = "idx AS (SELECT DISTINCT e.source_file AS file_path, CASE WHEN t.id % 10 = 0 THEN '*' ELSE t.name END AS imported_name, t.file_path AS target_file FROM sparse e JOIN nodes t ON t.id = e.target_id WHERE e.type = 'IMPORTS' AND e.source_file <> t.file_path)"
METHODS = "meth AS (SELECT m.id, m.name, c.name AS cname, c.file_path AS cfile, c.label AS clabel FROM nodes m JOIN nodes c ON c.id = m.parent_id WHERE m.label = 'Method' AND c.label IN ('Class', 'Interface'))"
RECEIVER = "regexp_extract(q, '^(.+)\\.[A-Za-z0-9_]+$', 1)"
CANDIDATES = f"""cand AS (
SELECT c.*, 1 AS step, min(n.id) AS id FROM calls c JOIN nodes n ON n.name = c.callee_name AND n.file_path = c.file_path GROUP BY ALL HAVING count(*) = 1 AND min(n.id) <> c.caller_id
UNION ALL SELECT c.*, 2, n.id FROM calls c JOIN idx i ON i.file_path = c.file_path AND i.imported_name IN (c.callee_name, '*') JOIN nodes n ON n.name = c.callee_name AND n.file_path = i.target_file AND n.id <> c.caller_id
UNION ALL SELECT c.*, 3, n.id FROM calls c JOIN idx i ON i.file_path = c.file_path AND i.imported_name = {RECEIVER} AND {RECEIVER} <> '' JOIN nodes n ON n.name = c.callee_name AND n.file_path = i.target_file AND n.id <> c.caller_id
UNION ALL SELECT c.*, 4, m.id FROM calls c JOIN idx i ON i.file_path = c.file_path AND i.imported_name <> '*' JOIN meth m ON m.cname = i.imported_name AND m.cfile = i.target_file AND m.name = c.callee_name AND m.id <> c.caller_id
UNION ALL SELECT c.*, 5, m.id FROM calls c JOIN (SELECT name, min(id) AS id FROM meth WHERE clabel = 'Class' GROUP BY 1 HAVING count(*) = 1) m ON m.name = c.callee_name AND m.id <> c.caller_id WHERE c.file_path IN (SELECT file_path FROM idx)
UNION ALL SELECT c.*, CASE WHEN count(*) = 1 THEN 6 ELSE 8 END, min(n.id) FROM calls c JOIN nodes n ON n.name = c.callee_name AND n.id <> c.caller_id GROUP BY ALL
UNION ALL SELECT c.*, 7, m.id FROM calls c JOIN meth m ON m.cname = {RECEIVER} AND m.name = c.callee_name AND m.id <> c.caller_id)"""
RESOLVED = "res AS (SELECT caller_id, id AS target_id, min((line, step, callee_name, file_path)) AS f FROM (SELECT *, row_number() OVER (PARTITION BY file_path, caller_id, callee_name, q, line ORDER BY step, id) AS k FROM cand) WHERE k = 1 GROUP BY 1, 2)"
add_both("import_index", _index, "nodes sparse", "SELECT * FROM idx", INDEX)
add_both(
    "resolve_cascade",
    lambda g, e: rv.resolve(_calls(g, e), g.nodes, _index(g, e)).select("source_id", "target_id", "source_line", "resolution_method", "confidence", "trust_tier"),
    "nodes sparse",
    "SELECT caller_id AS source_id, target_id, f[1] AS source_line, CASE WHEN f[2] = 1 THEN 'same_file' WHEN f[2] <= 5 THEN 'import' WHEN f[2] = 6 THEN 'verified_unique' WHEN f[2] = 7 THEN 'type_flow' ELSE 'name_match' END AS resolution_method, CASE WHEN f[2] <= 3 THEN 1.0E0 WHEN f[2] = 4 OR f[2] = 6 THEN 0.95E0 WHEN f[2] = 5 THEN 0.85E0 WHEN f[2] = 7 THEN 0.9E0 WHEN n = 2 THEN 0.6E0 WHEN n <= 5 THEN 0.4E0 ELSE 0.2E0 END AS confidence, CASE WHEN f[2] < 8 THEN 'CERTIFIED' WHEN n = 2 THEN 'CANDIDATE' ELSE 'SPECULATIVE' END AS trust_tier FROM (SELECT r.*, (SELECT count(*) FROM nodes m WHERE m.name = r.f[3] AND m.id <> r.caller_id) AS n FROM res r)",
    ", ".join([CALLS, INDEX, METHODS, CANDIDATES, RESOLVED]),
)
add(
    "module_lookup",
    lambda g: rv.aliases(g.nodes).groupBy("alias").agg(F.count(F.lit(1)).alias("files")),
    "nodes",
    "SELECT alias, count(*) AS files FROM (SELECT DISTINCT file_path, unnest([concat_ws('.', p[1], p[2], p[3]), concat_ws('/', p[1], p[2], p[3]), concat_ws('.', p[2], p[3]), concat_ws('/', p[2], p[3]), p[3]]) AS alias FROM (SELECT DISTINCT file_path, string_split(regexp_replace(file_path, '\\.py$', ''), '/') AS p FROM nodes)) GROUP BY 1",
)
add(
    "relative_modules",
    lambda g: g.nodes.select("file_path").distinct().select("file_path", rv.absolute_module(F.col("file_path"), F.lit("../x/y")).alias("up"), rv.absolute_module(F.col("file_path"), F.lit(".z")).alias("here"), rv.absolute_module(F.col("file_path"), F.lit("a.b")).alias("plain")),
    "nodes",
    "SELECT DISTINCT file_path, concat(string_split(file_path, '/')[1], '/x/y') AS up, concat(string_split(file_path, '/')[1], '/', string_split(file_path, '/')[2], '/z') AS here, 'a.b' AS plain FROM nodes",
)
add(
    "nearest_by_path",
    lambda g: rv.nearest_by_path(g.nodes.where("id % 10 = 0").select("file_path", F.lit("red_plate").alias("name")).distinct(), g.nodes),
    "nodes",
    "SELECT file_path, 'red_plate' AS name, node_id, score FROM (SELECT w.file_path, n.id AS node_id, CASE WHEN string_split(w.file_path, '/')[1] <> string_split(n.file_path, '/')[1] THEN 0 WHEN string_split(w.file_path, '/')[2] <> string_split(n.file_path, '/')[2] THEN 1 ELSE 102 END AS score FROM (SELECT DISTINCT file_path FROM nodes WHERE id % 10 = 0) w CROSS JOIN (SELECT * FROM nodes WHERE name = 'red_plate') n) QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, node_id) = 1",
)
add(
    "class_lookup",
    lambda g: rv.class_named(g.nodes.where("id % 5 = 0").select("file_path", "name").distinct(), g.nodes),
    "nodes",
    "SELECT w.file_path, w.name, arg_min(n.id, n.id + CASE WHEN n.file_path = w.file_path THEN 0 ELSE 1000000000 END) AS node_id FROM (SELECT DISTINCT file_path, name FROM nodes WHERE id % 5 = 0) w JOIN nodes n ON n.name = w.name AND n.label IN ('Class', 'Interface') GROUP BY 1, 2",
)


def _pairs(g: Graph) -> DataFrame:
    return g.nodes.withColumn("name", F.concat(F.when(F.col("id") % 2 == 0, "to_").otherwise("from_"), F.col("name")))


add(
    "serialization_pairs",
    lambda g: rv.serialization_pairs(_pairs(g), [("to_", "from_"), ("encode", "decode")]),
    "nodes",
    "SELECT a.id, b.id AS other_id, 0.8E0 AS confidence FROM nodes a JOIN nodes b ON a.file_path = b.file_path AND coalesce(a.parent_id, 0) = coalesce(b.parent_id, 0) AND a.name = b.name AND a.id % 2 <> b.id % 2 WHERE a.label IN ('Function', 'Method') AND b.label IN ('Function', 'Method')",
)
add(
    "edge_verification",
    lambda g: rv.verified_edges(
        g.numbered_edges.where("id % 50 = 0").select(F.col("id").alias("edge_id"), "target_id"),
        g.numbered_edges.where("id % 50 = 0").join(g.nodes.select(F.col("id").alias("_t"), "name", "file_path", "start_line"), F.col("target_id") == F.col("_t")).select(F.col("id").alias("edge_id"), F.substring_index("file_path", "/", -2).alias("file"), F.when(F.col("id") % 100 == 0, F.col("name")).otherwise("gone").alias("name"), F.col("start_line").alias("line")),
        g.nodes,
    ),
    "nodes edges",
    "SELECT e.id AS edge_id, CASE WHEN e.id % 100 <> 0 THEN 'deleted' WHEN b.id = e.target_id THEN 'verified' ELSE 'corrected' END AS outcome, CASE WHEN e.id % 100 <> 0 THEN e.target_id ELSE b.id END AS target_id FROM edges e JOIN nodes t ON t.id = e.target_id LEFT JOIN LATERAL (SELECT n.id FROM nodes n WHERE n.name = t.name AND n.file_path LIKE concat('%', string_split(t.file_path, '/')[2], '/', string_split(t.file_path, '/')[3]) AND t.start_line BETWEEN n.start_line AND n.end_line ORDER BY n.start_line DESC, n.id LIMIT 1) b ON true WHERE e.id % 50 = 0",
)

# Stored tables

add(
    "schema_check",
    lambda g: g.spark.createDataFrame([(n, len(st.check_columns(getattr(g, n), n))) for n in ("nodes", "edges", "properties")], "name string, lacking int"),
    "",
    "SELECT * FROM (VALUES ('nodes', 0), ('edges', 1), ('properties', 0)) t(name, lacking)",
)
add("numbered_rows", lambda g: st.numbered(g.nodes.select("file_path", F.col("id").alias("node")), ["file_path", "node"]), "nodes", "SELECT row_number() OVER (ORDER BY file_path, id) AS id, file_path, id AS node FROM nodes")
add("hash_upsert", lambda g: st.upserted(g.nodes.groupBy("file_path").agg(F.sum("id").alias("hash")), g.nodes.where("id % 3 = 0").groupBy("file_path").agg(F.max("id").alias("hash")), ["file_path"]), "nodes", "SELECT file_path, coalesce(max(CASE WHEN id % 3 = 0 THEN id END), CAST(sum(id) AS BIGINT)) AS hash FROM nodes GROUP BY 1")
add("latest_metadata", lambda g: st.latest(g.interventions.select("run_id", "ts", "id", "tool"), ["run_id"], ["ts", "id"]).select("run_id", "id", "tool"), "interventions", "SELECT run_id, id, tool FROM interventions QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, id DESC) = 1")
add("package_upsert", lambda g: st.latest(g.nodes.select("name", F.col("language").alias("package_manager"), F.col("id").alias("version")), ["name", "package_manager"], ["version"]), "nodes", "SELECT name, language AS package_manager, max(id) AS version FROM nodes GROUP BY 1, 2")


def _left(g: Graph) -> DataFrame:
    kept = st.without_files({"nodes": g.nodes, "edges": g.edges, "properties": g.properties}, g.nodes.where(F.col("file_path") == FILE).select("file_path").distinct())
    count = lambda n: kept[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return count("nodes").unionByName(count("edges")).unionByName(count("properties"))


add(
    "delete_file",
    _left,
    "properties edges",
    f"SELECT 'nodes' AS name, count(*) AS n FROM nodes WHERE file_path <> '{FILE}' UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_file <> '{FILE}' AND target_id NOT IN (SELECT id FROM nodes WHERE file_path = '{FILE}') UNION ALL SELECT 'properties', count(*) FROM properties WHERE node_id NOT IN (SELECT id FROM nodes WHERE file_path = '{FILE}')",
)
add("log_outcomes", lambda g: st.with_outcome(g.interventions.select("id", "run_id"), g.interventions.where("ai_called").select("id", (F.col("latency_ms") % 10 / 10).alias("compliance"), (F.col("id") + 1).alias("validation_id"))), "interventions", "SELECT id, run_id, CASE WHEN ai_called THEN latency_ms % 10 / 10.0E0 END AS compliance, CASE WHEN ai_called THEN id + 1 END AS validation_id FROM interventions")
add("token_index", lambda g: st.token_index(g.table("benchmark"), "item_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("items"), F.sum("tf").alias("tf")), "", "SELECT token, count(DISTINCT item_id) AS items, count(*) AS tf FROM (SELECT item_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS token FROM benchmark) GROUP BY 1")
add("telemetry_lines", lambda g: st.parsed_lines(g.table("events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("line")), "line", "k INT").select("event_id", "record.k"), "", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 10 <> 0")
add(
    "file_status",
    lambda g: st.file_status(g.nodes.where("id % 3 <> 0").groupBy("file_path").agg(F.max("id").alias("mtime"), F.sum("end_line").alias("size")), g.nodes.where("id % 4 <> 0").groupBy("file_path").agg(F.max("id").alias("mtime"), F.sum("end_line").alias("size"))),
    "nodes",
    "SELECT file_path, CASE WHEN a.m IS NULL THEN 'new' WHEN b.m IS NULL THEN 'deleted' WHEN a.m = b.m AND a.s = b.s THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT file_path, max(id) AS m, sum(end_line) AS s FROM nodes WHERE id % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT file_path, max(id) AS m, sum(end_line) AS s FROM nodes WHERE id % 4 <> 0 GROUP BY 1) b USING (file_path)",
)
add("overall_freshness", lambda g: st.worst_freshness(g.interventions.select(F.when(F.col("latency_ms") < 100, "FRESH").otherwise("SLIGHTLY_STALE").alias("freshness"))), "interventions", "SELECT CASE WHEN max(latency_ms) < 100 THEN 'FRESH' ELSE 'SLIGHTLY_STALE' END AS freshness FROM interventions")
add(
    "commit_log",
    lambda g: g.commit_files.groupBy("commit_id", "ts").agg(F.array_sort(F.collect_set("file_path")).alias("files")).orderBy(F.desc("ts"), F.desc("commit_id")).limit(500).select("commit_id", F.size("files").alias("n"), F.array_join("files", ",").alias("files")),
    "commit_files",
    "SELECT commit_id, count(*) AS n, string_agg(file_path, ',' ORDER BY file_path) AS files FROM (SELECT DISTINCT commit_id, ts, file_path FROM commit_files) GROUP BY commit_id, ts ORDER BY ts DESC, commit_id DESC LIMIT 500",
)
add("corpus_scan", lambda g: g.table("documents").where(F.octet_length("text") <= 4000).select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path")), "", "SELECT doc_id, concat(source, '/', CAST(doc_id AS STRING)) AS file_path FROM documents WHERE strlen(text) <= 4000")
add("file_hashes", lambda g: g.sources.select("file_path", F.length(F.sha2("text", 256)).alias("n"), F.size(F.split("text", "\n")).alias("lines")), "blocks", "SELECT file_path, 64 AS n, 2 + 8 * count(*) AS lines FROM blocks GROUP BY 1")


def _relations(g: Graph) -> DataFrame:
    """Relations stated by generated lines: every fifth node's file has a class that extends a name."""
    rows = g.nodes.where("id % 5 = 0 AND label IN ('Class', 'Interface')").select("file_path", F.lit("python").alias("language"), F.col("start_line").alias("line"), F.concat(F.lit("class "), "name", F.lit("(red_plate):")).alias("text"), F.lit(0).alias("indent"))
    return rv.relationships(rows, g.nodes).select("target_id", "type", "confidence").distinct()


add(
    "relationships",
    _relations,
    "nodes",
    "SELECT DISTINCT t.id AS target_id, 'EXTENDS' AS type, 0.95E0 AS confidence FROM (SELECT n.file_path, n.name, arg_min(c.id, c.id + CASE WHEN c.file_path = n.file_path THEN 0 ELSE 1000000000 END) AS id FROM nodes n JOIN nodes c ON c.name = 'red_plate' AND c.label IN ('Class', 'Interface') WHERE n.id % 5 = 0 AND n.label IN ('Class', 'Interface') GROUP BY 1, 2) t JOIN nodes o ON o.file_path = t.file_path AND o.name = t.name AND o.label IN ('Class', 'Interface') WHERE o.id <> t.id",
)


def _replaced(g: Graph) -> DataFrame:
    """All edges of a stored graph, after one file was replaced by one whose functions have new names in part."""
    versions = scratch(g.spark, "graph")
    replacing.create(versions, {"nodes": g.nodes, "edges": g.edges, "properties": g.properties})
    renamed = g.nodes.where(F.col("file_path") == FILE).withColumn("name", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("_new"))).otherwise(F.col("name")))
    replacing.replace_files(versions, renamed.select("file_path").distinct(), renamed.drop("id"))
    targets = versions.read("nodes").select(F.col("id").alias("target_id"), F.col("file_path").alias("target_file"), F.col("name").alias("target_name"))
    return versions.read("edges").join(targets, "target_id").select("source_id", "type", "target_file", "target_name", "resolution_method", "confidence", "candidate_count")


add(
    "replaced_graph",
    _replaced,
    "nodes edges",
    f"""SELECT e.source_id, e.type, t.file_path AS target_file, t.name AS target_name, e.resolution_method, e.confidence, e.candidate_count FROM edges e JOIN nodes t ON t.id = e.target_id WHERE e.source_file <> '{FILE}' AND t.file_path <> '{FILE}'
UNION ALL SELECT e.source_id, e.type, t.file_path, t.name, CASE WHEN c.n = 1 AND e.resolution_method IN ('same_file', 'import') THEN e.resolution_method ELSE 'name_match' END,
CASE WHEN c.n = 1 AND e.resolution_method IN ('same_file', 'import') THEN CASE WHEN e.confidence < 0.5 THEN 1.0E0 ELSE e.confidence END WHEN c.n = 1 THEN 0.9E0 WHEN c.n = 2 THEN 0.6E0 WHEN c.n <= 5 THEN 0.4E0 ELSE 0.2E0 END, CAST(c.n AS INT)
FROM edges e JOIN nodes t ON t.id = e.target_id JOIN (SELECT CASE WHEN id % 3 = 0 THEN concat(name, '_new') ELSE name END AS name, count(*) AS n FROM nodes WHERE file_path = '{FILE}' GROUP BY 1) c ON c.name = t.name WHERE t.file_path = '{FILE}' AND e.source_file <> '{FILE}'""",
)

#: What is searched in the stored index.
SOUGHT = ["the", "of", "and", "river", "house", "der", "le", "que"]


def _searched(g: Graph) -> DataFrame:
    """The best documents of a stored index, after a tenth of them was replaced and a seventh deleted."""
    versions, docs = scratch(g.spark, "index"), g.table("documents").select("doc_id", "text").where("doc_id IS NOT NULL")
    inverted.build(versions, docs, "doc_id", "text")
    inverted.update(versions, docs.where("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" river house river"))), "doc_id", "text", docs.where("doc_id % 7 = 3").select("doc_id"))
    return inverted.search(versions, SOUGHT, 50).withColumnRenamed("key", "doc_id")


add(
    "stored_search",
    _searched,
    "",
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat(text, ' river house river') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3 AND text IS NOT NULL),
t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS tokens FROM d),
l AS (SELECT doc_id, len(tokens) AS n, tokens FROM t WHERE len(tokens) > 0),
m AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
f AS (SELECT doc_id, n, token, count(*) AS tf FROM (SELECT doc_id, n, unnest(tokens) AS token FROM l) WHERE token IN ({", ".join(f"'{w}'" for w in SOUGHT)}) GROUP BY 1, 2, 3),
w AS (SELECT token, ln(1 + ((SELECT docs FROM m) - count(*) + 0.5E0) / (count(*) + 0.5E0)) AS idf FROM f GROUP BY 1)
SELECT doc_id, round(sum(idf * tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * n / (SELECT mean FROM m)))), 6) AS score FROM f JOIN w USING (token) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
