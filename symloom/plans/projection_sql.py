"""The projection of the relational tables onto the graph model as SQL for the oracle."""

NODES = """nodes AS (
SELECT CAST(p_partkey AS BIGINT) + 1 AS id,
       CASE p_partkey % 8 WHEN 6 THEN 'Class' WHEN 7 THEN 'Interface' WHEN 4 THEN 'Method' WHEN 5 THEN 'Method' ELSE 'Function' END AS label,
       replace(p_name, ' ', '_') AS name,
       concat(lower(p_type), '.', replace(p_name, ' ', '_')) AS qualified_name,
       concat(CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE 'src/' END, lower(replace(p_brand, '#', '')), '/', lower(p_type), '.py') AS file_path,
       CAST((p_partkey % 97) * 10 + 1 AS INT) AS start_line,
       CAST((p_partkey % 97) * 10 + 1 + p_size AS INT) AS end_line,
       concat(replace(p_name, ' ', '_'), CASE p_partkey % 4 WHEN 0 THEN '()' WHEN 1 THEN '(a)' WHEN 2 THEN '(a, b)' ELSE '(a, b, c, d, e, f)' END) AS signature,
       CASE p_partkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN p_type ELSE '' END AS return_type,
       p_size % 4 <> 0 AS is_exported,
       p_size % 10 = 0 AS is_test,
       CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'typescript' END AS language,
       CASE WHEN p_partkey % 8 IN (4, 5) THEN CAST(p_partkey - p_partkey % 8 + 7 AS BIGINT) ELSE CAST(NULL AS BIGINT) END AS parent_id
FROM part)"""

EDGES = """raw_edges AS (
  SELECT l_orderkey % (SELECT count(*) FROM part) + 1 AS source_id, l_partkey + 1 AS target_id,
         CASE WHEN l_linenumber <= 4 THEN 'CALLS' WHEN l_linenumber = 5 THEN 'IMPORTS' WHEN l_linenumber = 6 THEN 'EXTENDS' ELSE 'USES' END AS type,
         CAST(l_quantity AS INT) AS source_line,
         CAST(round(l_discount * 100) AS INT) AS d,
         concat(l_returnflag, l_linestatus) AS fl
  FROM lineitem),
one_edges AS (SELECT source_id, target_id, type, min(source_line) AS source_line, min(d) AS d, min(fl) AS fl FROM raw_edges WHERE source_id <> target_id GROUP BY source_id, target_id, type),
edges AS (
SELECT row_number() OVER (ORDER BY o.source_id, o.target_id, o.type) AS id, o.source_id, o.target_id, o.type, o.source_line, n.file_path AS source_file,
       CASE o.fl WHEN 'AF' THEN 'same_file' WHEN 'AO' THEN 'import' WHEN 'NF' THEN 'name_match' WHEN 'NO' THEN 'verified_unique' WHEN 'RF' THEN 'type_flow' ELSE 'import' END AS resolution_method,
       CASE WHEN o.d <= 2 THEN 1.0E0 WHEN o.d <= 4 THEN 0.9E0 WHEN o.d <= 6 THEN 0.6E0 WHEN o.d <= 8 THEN 0.4E0 ELSE 0.2E0 END AS confidence,
       CASE WHEN o.d <= 4 THEN 'CERTIFIED' WHEN o.d <= 6 THEN 'CANDIDATE' ELSE 'SPECULATIVE' END AS trust_tier,
       CAST(o.d + 1 AS INT) AS candidate_count
FROM one_edges o JOIN nodes n ON n.id = o.source_id)"""

SPARSE = "sparse AS (SELECT * FROM edges WHERE (source_id * 31 + target_id) % 37 = 0)"

COMMITS = """commit_files AS (
SELECT DISTINCT o.o_orderkey AS commit_id, o.o_orderdate AS ts, n.file_path
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nodes n ON n.id = l.l_partkey + 1)"""

PROPERTIES = """properties AS (
SELECT CAST(n.id * 8 + k.i AS BIGINT) AS id, n.id AS node_id, k.kind, concat(k.kind, ':', CAST(n.id % 5 AS STRING)) AS value, n.start_line + k.i AS line, CASE WHEN n.id % 2 = 0 THEN 1.0E0 ELSE 0.8E0 END AS confidence
FROM nodes n CROSS JOIN (SELECT 0 AS i, 'guard_clause' AS kind UNION ALL SELECT 1, 'return_shape' UNION ALL SELECT 2, 'exception_type' UNION ALL SELECT 3, 'docstring' UNION ALL SELECT 4, 'side_effect' UNION ALL SELECT 5, 'field_read') k
WHERE n.label IN ('Function', 'Method') AND (n.id + k.i) % 3 <> 0)"""

ASSERTIONS = """assertions AS (
SELECT e.id, e.source_id AS test_node_id, CASE WHEN e.confidence >= 0.9E0 THEN e.target_id ELSE 0 END AS target_node_id,
       CASE e.id % 3 WHEN 0 THEN 'assertEqual' WHEN 1 THEN 'assertRaises' ELSE 'assert' END AS kind,
       concat('check(', t.name, '(x))') AS expression, CAST(e.source_line AS STRING) AS expected, e.source_line AS line
FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE s.is_test AND e.type = 'CALLS')"""

INTERVENTIONS = """interventions AS (
SELECT event_id AS id, ts, concat('tool_', event_type) AS tool, user_id AS run_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'brief' ELSE 'validate' END AS phase,
       CASE WHEN event_type = 'error' THEN 'errors_found' WHEN event_type = 'purchase' THEN 'fixed_ai' ELSE 'valid' END AS outcome,
       CAST(round(value) AS INT) AS latency_ms, event_type = 'purchase' AS ai_called, props
FROM events)"""

# The definitions that the generated source files have, with the line of each block's first line. Class blocks begin with a decorator.
BLOCKS = """blocks AS (
SELECT *, CAST(3 + (row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) - 1) * 8 AS INT) AS s FROM nodes)"""

VIEWS = {"blocks": BLOCKS, "nodes": NODES, "edges": EDGES, "sparse": SPARSE, "commit_files": COMMITS, "properties": PROPERTIES, "assertions": ASSERTIONS, "interventions": INTERVENTIONS}
NEEDS = {"blocks": ["nodes"], "edges": ["nodes"], "sparse": ["edges"], "commit_files": ["nodes"], "properties": ["nodes"], "assertions": ["nodes", "edges"]}


def oracle(views: str, sql: str, more: str = "") -> str:
    """``sql`` over the named views and the views that they need; ``more``: further common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for v in views.split():
        need(v)
    parts = [VIEWS[v] for v in order] + ([more] if more else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql
