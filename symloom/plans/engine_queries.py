"""Queries of the query surface, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine
from .registry import FE, add

FILE = "src/brand4/large.py"
USES = "uses AS (SELECT target_id, count(*) AS n FROM edges GROUP BY 1)"
PAIR = "CASE WHEN c >= 0.9E0 AND calls >= 2 THEN 'HIGH' WHEN c >= 0.5E0 THEN 'MODERATE' ELSE 'LOW' END"
LEVEL = "CASE WHEN count(*) OVER (PARTITION BY target_id) >= 5 THEN 'HIGH' WHEN count(*) OVER (PARTITION BY target_id) >= 2 THEN 'MODERATE' ELSE 'LOW' END"

add("ask_symbols", lambda g: Engine(g).ask("list the symbols in this file", FILE).select("id", "name", "usage_count"), "nodes edges", f"SELECT id, name, coalesce(n, 0) AS usage_count FROM nodes LEFT JOIN uses ON target_id = id WHERE file_path = '{FILE}'", USES)
add("ask_impact", lambda g: Engine(g).ask("what does a change break?", "red_plate"), "nodes edges", f"SELECT * FROM (SELECT target_id, source_file, calls, {PAIR} AS break_risk, {LEVEL} AS level FROM (SELECT e.target_id, e.source_file, count(*) AS calls, max(e.confidence) AS c FROM edges e JOIN nodes t ON t.id = e.target_id WHERE e.type = 'CALLS' AND e.source_file <> t.file_path GROUP BY 1, 2)) WHERE target_id IN (SELECT id FROM nodes WHERE name = 'red_plate')")
add("ask_hotspots", lambda g: Engine(g).ask("most used code", ""), "nodes edges", "SELECT id, name, file_path, n AS usage_count FROM nodes JOIN uses ON target_id = id WHERE NOT is_test ORDER BY n DESC, id LIMIT 10", USES)
add(
    "explain_symbol",
    lambda g: Engine(g).explain("red_plate").select("id", "usage_count", "guard_clause", "return_shape", "tests"),
    "properties edges",
    "SELECT n.id, coalesce(uses.n, 0) AS usage_count, g.v AS guard_clause, r.v AS return_shape, coalesce(t.n, 0) AS tests FROM nodes n LEFT JOIN uses ON uses.target_id = n.id LEFT JOIN (SELECT node_id, max(value) AS v FROM properties WHERE kind = 'guard_clause' GROUP BY 1) g ON g.node_id = n.id LEFT JOIN (SELECT node_id, max(value) AS v FROM properties WHERE kind = 'return_shape' GROUP BY 1) r ON r.node_id = n.id LEFT JOIN (SELECT target_id, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes x ON x.id = e.target_id WHERE e.type = 'CALLS' AND s.is_test AND NOT x.is_test GROUP BY 1) t ON t.target_id = n.id WHERE n.name = 'red_plate'",
    USES,
)
add("symbol_context", lambda g: Engine(g).context("red_plate"), "nodes edges", "SELECT target_id AS symbol_id, source_file AS referenced_in_file, source_line AS referenced_at_line, CASE type WHEN 'IMPORTS' THEN 'import' ELSE 'call' END AS reference_type FROM edges WHERE confidence >= 0.5E0 AND target_id IN (SELECT id FROM nodes WHERE name = 'red_plate') ORDER BY source_file, source_line, target_id LIMIT 10")
add(
    "brief",
    lambda g: Engine(g).brief("Fix the red plate and the rod in this"),
    "nodes edges",
    "SELECT id, name, file_path, usage_count, CASE WHEN usage_count >= 20 THEN 'many users' ELSE '' END AS warning FROM (SELECT id, name, file_path, coalesce(n, 0) AS usage_count, len(list_filter(string_split(name, '_'), lambda x: x IN ('red', 'plate', 'rod'))) AS hits FROM nodes LEFT JOIN uses ON target_id = id) WHERE hits > 0 ORDER BY hits DESC, usage_count DESC, id LIMIT 5",
    USES,
)
add(
    "orient",
    lambda g: Engine(g).orient(),
    "nodes edges",
    "SELECT 'folder' AS section, name, n FROM (SELECT regexp_replace(file_path, '/[^/]*$', '') AS name, count(DISTINCT file_path) AS n FROM nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) UNION ALL SELECT 'entry', name, n FROM (SELECT file_path AS name, CAST(sum(n) AS BIGINT) AS n FROM nodes JOIN uses ON target_id = id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) UNION ALL SELECT 'hotspot', name, n FROM (SELECT name, n, id FROM nodes JOIN uses ON target_id = id WHERE NOT is_test ORDER BY n DESC, id LIMIT 5)",
    USES,
)
add(
    "validate_imports",
    lambda g: Engine(g).validate(g.nodes.where("id % 10 = 0").select("file_path", F.replace(F.regexp_replace("file_path", r"\.py$", ""), F.lit("/"), F.lit(".")).alias("module_path"), F.lit("zzz_zzzzzzzzzzzzzz").alias("imported_name"))),
    "nodes",
    "SELECT n.file_path, replace(regexp_replace(n.file_path, '\\.py$', ''), '/', '.') AS module_path, 'zzz_zzzzzzzzzzzzzz' AS imported_name, CASE WHEN c.n >= 5 THEN 'unknown' ELSE 'silent' END AS verdict, '' AS suggestion FROM nodes n JOIN (SELECT file_path, count(*) AS n FROM nodes GROUP BY 1) c ON c.file_path = n.file_path WHERE n.id % 10 = 0",
)
add("find_relevant_text", lambda g: Engine(g).find_relevant("a bug in the red plate", 5, 1).where("distance = 0").select("file_path", "score"), "nodes", "SELECT file_path, 1.5E0 AS score FROM (SELECT file_path, count(*) AS names FROM (SELECT DISTINCT file_path, name FROM nodes) WHERE len(list_filter(string_split(name, '_'), lambda x: x <> '' AND x NOT IN ('a', 'bug', 'in', 'the', 'red', 'plate'))) = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)")
