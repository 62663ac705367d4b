"""Queries over source files that are generated from the graph's nodes; their SQL says what parsing must find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import parsing as ps
from ..sources.graph import Graph
from ..sources.shared import stored
from .registry import add


def _lines(g: Graph) -> DataFrame:
    return ps.statements(ps.sources(g.sources))


def _parsed(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ps.parsed(ps.sources(files))


def _nodes(files: DataFrame) -> DataFrame:
    """The definitions of sources, whose lines are stored first, as they are read several times."""
    return ps.definitions(stored(ps.statements(ps.sources(files)), "parse-lines"))


def _properties(g: Graph) -> DataFrame:
    rows, nodes, body = _parsed(g.sources)
    return ps.properties(body, nodes, rows).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def _mixed_calls(g: Graph) -> DataFrame:
    _, nodes, body = _parsed(g.mixed_sources)
    found = ps.calls(body).join(nodes.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
    return found.select("file_path", "caller", "callee_qualified", "line", F.coalesce("context", F.lit("")).alias("context"))


def _mixed_properties(g: Graph) -> DataFrame:
    rows, nodes, body = _parsed(g.mixed_sources)
    found = ps.properties(body, nodes, rows).join(nodes.select(F.col("id").alias("node_id"), "file_path", "name"), "node_id")
    return found.select("file_path", "name", "kind", "value", "line")


#: What each file of three languages holds, by the remainder of its node's id.
MIXED = "mixed AS (SELECT id, name, id % 3 AS k, concat('gen/f', CAST(id AS STRING), CASE id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.java' END) AS file_path, concat('helper_', CAST(id % 5 AS STRING)) AS helper, concat('key_', CAST(id % 7 AS STRING)) AS env, CAST(id % 10 AS STRING) AS most FROM nodes)"


def _facts(names: str, of: dict[int, list[str]]) -> str:
    """SQL of the rows that files of each language have, a row given as its columns."""
    plain = " UNION ALL ".join(f"SELECT file_path, {r} FROM mixed WHERE k = {k}" for k, rows in of.items() for r in rows)
    return f"SELECT * FROM ({plain}) AS f(file_path, {names})"


ARITY = "(CASE id % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 6 END)"

add(
    "parse_nodes",
    lambda g: _nodes(g.sources).select("file_path", "label", "name", "qualified_name", "start_line", "end_line", "is_exported", "is_test", "language"),
    "blocks",
    """SELECT file_path, 'Function' AS label, name, name AS qualified_name, s AS start_line, s + 6 AS end_line, true AS is_exported, is_test, 'python' AS language FROM blocks WHERE label <> 'Class'
UNION ALL SELECT file_path, 'Class', name, name, s + 1, s + 4, true, is_test, 'python' FROM blocks WHERE label = 'Class'
UNION ALL SELECT file_path, 'Method', 'run', concat(name, '.run'), s + 3, s + 4, true, is_test, 'python' FROM blocks WHERE label = 'Class'""",
)
add(
    "parse_calls",
    lambda g: ps.calls(_parsed(g.sources)[2]).select("file_path", "callee_name", "line", F.coalesce("context", F.lit("")).alias("context")),
    "blocks",
    """SELECT file_path, concat('check_', CAST(id % 4 AS STRING)) AS callee_name, s + 2 AS line, 'boolean_check' AS context FROM blocks WHERE label <> 'Class'
UNION ALL SELECT file_path, CASE WHEN id % 2 = 0 THEN 'ValueError' ELSE 'KeyError' END, s + 3, '' FROM blocks WHERE label <> 'Class'
UNION ALL SELECT file_path, concat('helper_', CAST(id % 5 AS STRING)), s + 4, '' FROM blocks WHERE label <> 'Class'
UNION ALL SELECT file_path, 'assertEqual', s + 4, '' FROM blocks WHERE label <> 'Class' AND is_test
UNION ALL SELECT file_path, concat('fetch_', CAST(id % 3 AS STRING)), s + 5, 'iterated' FROM blocks WHERE label <> 'Class'""",
)
add("parse_imports", lambda g: ps.imports(_lines(g)), "nodes", "SELECT f.file_path, 1 AS line, 'lib.base' AS module_path, n.name AS imported_name FROM (SELECT DISTINCT file_path FROM nodes) f CROSS JOIN (VALUES ('helper_0'), ('helper_1')) n(name)")
add(
    "parse_properties",
    _properties,
    "blocks",
    f"""SELECT kind, value, count(*) AS n FROM (
SELECT 'docstring' AS kind, concat('Doc of ', name, '.') AS value FROM blocks WHERE label <> 'Class'
UNION ALL SELECT 'guard_clause', concat('check_', CAST(id % 4 AS STRING), '(a)') FROM blocks WHERE label <> 'Class'
UNION ALL SELECT 'exception_type', CASE WHEN id % 2 = 0 THEN 'ValueError' ELSE 'KeyError' END FROM blocks WHERE label <> 'Class'
UNION ALL SELECT 'exception_flow', concat('WHEN check_', CAST(id % 4 AS STRING), '(a): raise ', CASE WHEN id % 2 = 0 THEN 'ValueError' ELSE 'KeyError' END, '("bad")') FROM blocks WHERE label <> 'Class'
UNION ALL SELECT 'side_effect', 'total' FROM blocks WHERE label <> 'Class' AND NOT is_test
UNION ALL SELECT 'field_read', 'size' FROM blocks
UNION ALL SELECT 'return_shape', CASE id % 4 WHEN 0 THEN 'tuple|(a, item)' WHEN 1 THEN 'collection|[item]' WHEN 2 THEN 'none' ELSE 'value|item' END FROM blocks WHERE label <> 'Class'
UNION ALL SELECT 'return_shape', 'value|self.size' FROM blocks WHERE label = 'Class'
UNION ALL SELECT 'visibility', 'public' FROM blocks
UNION ALL SELECT 'visibility', 'public' FROM blocks WHERE label = 'Class'
UNION ALL SELECT 'class_field', 'size' FROM blocks WHERE label = 'Class'
UNION ALL SELECT 'class_decorator', 'dataclass' FROM blocks WHERE label = 'Class'
UNION ALL SELECT 'param', concat(p.name, ' [required]') FROM blocks JOIN (VALUES ('a', 1), ('b', 2), ('c', 3), ('d', 4), ('e', 5), ('f', 6)) p(name, k) ON p.k <= {ARITY} WHERE label <> 'Class'
UNION ALL SELECT 'caller_usage', concat('check_', CAST(id % 4 AS STRING), ':boolean_check') FROM blocks WHERE label <> 'Class'
UNION ALL SELECT 'caller_usage', concat('fetch_', CAST(id % 3 AS STRING), ':iterated') FROM blocks WHERE label <> 'Class'
UNION ALL SELECT 'fingerprint', '1|' FROM blocks WHERE label = 'Class'
UNION ALL SELECT 'fingerprint', concat(CAST({ARITY} AS STRING), '|', CASE WHEN id % 2 = 0 THEN 'ValueError' ELSE 'KeyError' END, CASE WHEN is_test THEN ',assertEqual' ELSE '' END, ',check_', CAST(id % 4 AS STRING), ',fetch_', CAST(id % 3 AS STRING), ',helper_', CAST(id % 5 AS STRING)) FROM blocks WHERE label <> 'Class')
GROUP BY 1, 2""",
)
add(
    "parse_assertions",
    lambda g: ps.assertions(_parsed(g.sources)[2]).select("kind", "expression", "expected", "line"),
    "blocks",
    "SELECT 'assertEqual' AS kind, concat('helper_', CAST(id % 5 AS STRING), '(a)') AS expression, CAST(id % 10 AS STRING) AS expected, s + 4 AS line FROM blocks WHERE label <> 'Class' AND is_test",
)
add(
    "scan_filters",
    lambda g: g.nodes.select("file_path").distinct().where(~ps.ignored(F.col("file_path"), ["# not these", "tests/", "*1/large.py", "!keep"])).withColumn("language", ps.language_of(F.col("file_path"))),
    "nodes",
    "SELECT DISTINCT file_path, 'python' AS language FROM nodes WHERE NOT regexp_matches(file_path, '(^|/)tests/') AND NOT regexp_matches(file_path, '(^|/)[^/]*1/large[.]py(/|$)')",
)
add(
    "generated_files",
    lambda g: ps.sources(g.sources.withColumn("text", F.when(F.col("file_path").contains("brand1"), F.concat(F.lit("# Code generated by x. DO NOT EDIT.\n"), "text")).otherwise(F.col("text")))).select("file_path"),
    "nodes",
    "SELECT DISTINCT file_path FROM nodes WHERE NOT contains(file_path, 'brand1')",
)
add(
    "package_manifests",
    lambda g: ps.manifests(g.table("nation").groupBy("n_regionkey").agg(F.concat(F.lit("# pinned\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit("=="), F.col("n_nationkey").cast("string"), F.lit(".0")))), "\n")).alias("text")).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/requirements.txt")).alias("file_path"), "text")),
    "",
    "SELECT lower(replace(n_name, ' ', '-')) AS name, concat(CAST(n_nationkey AS STRING), '.0') AS version, 'pip' AS package_manager, false AS is_dev FROM nation",
)
add(
    "parse_mixed_nodes",
    lambda g: _nodes(g.mixed_sources).select("file_path", "label", "qualified_name", "start_line", "end_line", "parameters", "return_type", "language"),
    "nodes",
    _facts(
        "label, qualified_name, start_line, end_line, parameters, return_type, language",
        {
            0: ["""'Function', name, 10, 28, 'a: str = "x, (y)", *rest', 'dict', 'python'"""],
            1: ["'Function', name, 6, 18, concat('a: string, n = ', most), '', 'typescript'"],
            2: ["'Class', 'Holder', 3, 21, '', '', 'java'", "'Method', 'Holder.size', 4, 4, '', '', 'java'", "'Method', concat('Holder.', name), 5, 20, 'Map<String, R> a, int n', '', 'java'"],
        },
    ),
    MIXED,
)
add(
    "parse_mixed_calls",
    _mixed_calls,
    "nodes",
    _facts(
        "caller, callee_qualified, line, context",
        {
            0: ["name, 'open', 22, 'exception_guard'", "name, 'f.read', 23, ''", "name, 'f.close', 24, ''", "name, 'RuntimeError', 26, ''", "name, 'Lock', 27, ''", "name, helper, 28, ''"],
            1: ["name, 'client.open', 12, 'exception_guard'", "name, 'client.send', 13, ''", "name, 'AppError', 15, ''", "name, helper, 17, ''"],
            2: ["'size', 'count', 4, ''", "name, 'store.open', 12, ''", "name, 'store.close', 13, ''", "name, helper, 15, ''", "name, 'tokenOf', 16, ''", "name, 'System.getenv', 16, ''", "name, 'IllegalStateException', 18, ''"],
        },
    ),
    MIXED,
)
add(
    "parse_mixed_imports",
    lambda g: ps.imports(ps.statements(ps.sources(g.mixed_sources))),
    "nodes",
    _facts("line, module_path, imported_name", {0: ["1, 'os', '*'", "1, 'sys', '*'", "2, 'lib.core', 'alpha'", "2, 'lib.core', 'beta'"], 1: ["1, './core', 'alpha'", "1, './core', 'beta'"], 2: ["2, 'lib.core', 'Alpha'"]}),
    MIXED,
)
add(
    "parse_mixed_properties",
    _mixed_properties,
    "nodes",
    _facts(
        "name, kind, value, line",
        {
            0: [
                "name, 'call_order', 'f: read -> close', 23", "name, 'caller_usage', 'open:exception_guard', 22", "name, 'concurrency_pattern', 'lock: async with Lock() as held:', 27",
                "name, 'conditional_return', concat('if a == ', most, ': return None'), 19", "name, 'config_read', concat('env: ', env), 20", "name, 'docstring', concat('Doc of ', name, '.'), 14",
                "name, 'exception_handler', 'except (OSError, ValueError) as e -> re-raises', 25", "name, 'exception_type', 'RuntimeError', 26", "name, 'fingerprint', concat('2|Lock,RuntimeError,close,', helper, ',open,read'), 10",
                "name, 'guard_clause', concat('a == ', most), 19", """name, 'param', 'a:str opt="x, (y)"', 10""", "name, 'param', 'rest [required]', 10", "name, 'resource_pattern', 'context_manager: open(a) as f', 22",
                "name, 'resource_pattern', 'context_manager: Lock() as held', 27", "name, 'return_shape', 'none', 19", """name, 'return_shape', concat('value|', helper, '(a, "call_in_string()")'), 28""",
                "name, 'visibility', 'public', 10", "name, 'security_tag', 'authentication: login', 10",
            ],
            1: [
                "name, 'call_order', 'client: open -> send', 12", "name, 'caller_usage', 'open:exception_guard', 12", "name, 'conditional_return', concat('if n > ', most, ': return null'), 9", "name, 'config_read', concat('env: ', env), 13",
                "name, 'exception_handler', 'catch (err) -> re-raises', 14", "name, 'exception_type', 'AppError', 15", "name, 'fingerprint', concat('2|AppError,', helper, ',open,send'), 6", "name, 'guard_clause', concat('n > ', most), 9",
                "name, 'param', 'a:string [required]', 6", "name, 'param', concat('n opt=', most), 6", "name, 'return_shape', 'none', 9", "name, 'visibility', 'public', 6",
            ],
            2: [
                "'Holder', 'visibility', 'public', 3", "'size', 'visibility', 'public', 4", "'size', 'fingerprint', '0|count', 4", "'size', 'return_shape', 'value|count()', 4", "name, 'call_order', 'store: open -> close', 12", "name, 'concurrency_pattern', 'lock: synchronized (this) {', 11",
                "name, 'conditional_return', concat('if n < ', most, ': return null'), 9", "name, 'config_read', concat('env: ', env), 16", "name, 'exception_handler', 'catch (IOException e) -> re-raises', 17", "name, 'exception_type', 'IllegalStateException', 18",
                "name, 'fingerprint', concat('2|IllegalStateException,close,getenv,', helper, ',open,tokenOf'), 5", "name, 'guard_clause', concat('n < ', most), 9", "name, 'param', 'a:Map<String, R> [required]', 5", "name, 'param', 'n:int [required]', 5",
                "name, 'resource_pattern', concat('using: Reader r = ', helper, '(a)'), 15", "name, 'return_shape', 'none', 9", """name, 'return_shape', concat('value|tokenOf(System.getenv("', env, '"))'), 16""", "name, 'visibility', 'public', 5",
            ],
        },
    )
    + """
UNION ALL SELECT file_path, name, 'boundary_condition', CASE k WHEN 0 THEN 'zero_check|a == 0 => return None' WHEN 1 THEN 'zero_check|n > 0 => {' ELSE 'zero_check|n < 0 => {' END, CASE k WHEN 0 THEN 18 ELSE 8 END FROM mixed WHERE id % 10 = 0""",
    MIXED,
)
