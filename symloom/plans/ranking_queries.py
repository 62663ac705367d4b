"""Queries of retrieval and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookups as lk
from ..operators import ranking as rk
from ..operators import retrieval as rt
from ..operators import text as tx
from ..sources.graph import Graph
from .registry import FE, add

FILE = "src/brand4/large.py"
TERMS = ["the", "that", "and", "der", "las", "pour"]
IN_TERMS = ", ".join(f"'{t}'" for t in TERMS)
ISSUES = "issues AS (SELECT id, file_path, name, start_line, concat('Crash in ', name, chr(10), 'Traceback: File \"/repo/', file_path, '\", line ', CAST(start_line AS STRING), ', in ', name, chr(10), 'see `', name, '` and ', file_path, ' test_', name, ' ValueError') AS text FROM nodes WHERE id % 40 = 0)"
STEM = "regexp_replace(string_split({}, '/')[-1], '\\.[^.]*$', '')"
DEG = "deg AS (SELECT t.file_path, count(*) AS n FROM edges e JOIN nodes t ON t.id = e.target_id WHERE e.type = 'CALLS' GROUP BY 1)"
COMMITS = "commits AS (SELECT o_orderkey AS commit_id, o_orderdate AS ts, concat(o_orderpriority, ' ', o_orderstatus) AS subject FROM orders)"


def issues(g: Graph) -> DataFrame:
    """Issue texts made of nodes: a frame, a quoted name, paths and a test."""
    text = F.concat(F.lit("Crash in "), "name", F.lit('\nTraceback: File "/repo/'), "file_path", F.lit('", line '), F.col("start_line").cast("string"), F.lit(", in "), "name", F.lit("\nsee `"), "name", F.lit("` and "), "file_path", F.lit(" test_"), "name", F.lit(" ValueError"))
    return g.nodes.where("id % 40 = 0").select("id", text.alias("text"))


def commits(g: Graph) -> DataFrame:
    return g.table("orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("subject"))


def called_files(g: Graph) -> DataFrame:
    """Files (key) with their number of incoming calls (score)."""
    into = g.edges.where("type = 'CALLS'").join(g.nodes.select(F.col("id").alias("target_id"), "file_path"), "target_id")
    return into.groupBy(F.col("file_path").alias("key")).agg(F.count(F.lit(1)).alias("score"))


def sized_files(g: Graph) -> DataFrame:
    """Files (key) with their number of nodes (score)."""
    return g.nodes.groupBy(F.col("file_path").alias("key")).agg(F.count(F.lit(1)).alias("score"))


SIZED = "siz AS (SELECT file_path, count(*) AS n FROM nodes GROUP BY 1)"


def _joined(g: Graph) -> DataFrame:
    a, b = called_files(g).withColumnRenamed("score", "calls"), sized_files(g).withColumnRenamed("score", "size")
    x = a.join(b, "key", "full").select("key", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("size", F.lit(0)).alias("size"))
    return x.select("key", ((F.col("calls") % 10) / 10).alias("semantic"), ((F.col("size") % 7) / 7).alias("lexical"), ((F.col("calls") % 3) / 3).alias("reach"), ((F.col("size") % 2) / 2).alias("proximity"), ((F.col("calls") % 5) / 5).alias("hub"))


JOINED = "j AS (SELECT file_path AS key, (c % 10) / 10.0E0 AS semantic, (s % 7) / 7.0E0 AS lexical, (c % 3) / 3.0E0 AS reach, (s % 2) / 2.0E0 AS proximity, (c % 5) / 5.0E0 AS hub FROM (SELECT file_path, coalesce(deg.n, 0) AS c, coalesce(siz.n, 0) AS s FROM deg FULL JOIN siz USING (file_path)))"
GRAPH = ", ".join([DEG, SIZED, JOINED])

add("issue_tokens", lambda g: g.table("benchmark").select("item_id", F.array_join(rt.issue_tokens(F.col("text")), " ").alias("tokens")))
add(
    "query_terms",
    lambda g: issues(g).select("id", F.array_join(rt.query_terms(F.col("text"), F.array(F.lit("ASTBuilder"))), " ").alias("terms")),
    "nodes",
    "SELECT id, array_to_string(list_distinct_ordered, ' ') AS terms FROM (SELECT id, list_concat(['ast', 'builder', 'crash', name, 'traceback', 'file', 'repo'], CASE WHEN starts_with(file_path, 'tests/') THEN ['tests'] ELSE [] END, CASE WHEN length(string_split(file_path, '/')[2]) >= 4 THEN [string_split(file_path, '/')[2]] ELSE [] END, CASE WHEN length({0}) >= 4 THEN [{0}] ELSE [] END, ['line'], ['test_' || name, 'valueerror']) AS list_distinct_ordered FROM nodes WHERE id % 40 = 0)".replace("{0}", STEM.format("file_path")),
)
add(
    "issue_anchors",
    lambda g: rt.issue_anchors(g, issues(g), "id", F.col("text")),
    "nodes",
    "SELECT id, name AS anchor, 'symbol' AS kind FROM issues UNION ALL SELECT id, concat('repo/', file_path), 'path' FROM issues UNION ALL SELECT id, file_path, 'path' FROM issues UNION ALL SELECT id, concat('test_', name), 'test' FROM issues",
    ISSUES,
)
add(
    "weighted_tokens",
    lambda g: rt.weighted_tokens(issues(g), "id", F.col("text")),
    "nodes",
    f"SELECT id, token, max(weight) AS weight FROM (SELECT id, unnest([{STEM.format('file_path')}, name, 'valueerror', concat('test_', name), 'crash', 'traceback', 'file', 'repo', string_split(file_path, '/')[1], string_split(file_path, '/')[2], 'line', CAST(start_line AS STRING), 'see']) AS token, unnest([4.0E0, 3, 3, 2, 1.5E0, 1, 1, 1, 1, 1, 1, 1, 1]) AS weight FROM issues) WHERE length(token) >= 3 GROUP BY 1, 2",
    ISSUES,
)
add("stack_frames", lambda g: rt.stack_frames(issues(g), "id", F.col("text")), "nodes", "SELECT id, 'python' AS language, 0 AS place, 0 AS depth, concat('/repo/', file_path) AS file, start_line AS line, name AS function FROM issues", ISSUES)
add("frames_in_repository", lambda g: rt.in_repository(g, rt.stack_frames(issues(g), "id", F.col("text"))).select("id", "file_path", "line"), "nodes", "SELECT id, file_path, start_line AS line FROM issues", ISSUES)
add(
    "lexical_file_search",
    lambda g: rt.bm25_of_matches(g.table("documents"), "doc_id", F.col("text"), TERMS),
    "",
    "SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5E0) / (df + 0.5E0)) * tf * 2.2E0 / (tf + 1.2E0 * (1 - 0.75E0 + 0.75E0 * n / mean))), 6) AS score FROM tf JOIN (SELECT token, count(*) AS df FROM tf GROUP BY 1) USING (token) CROSS JOIN (SELECT count(*) AS docs, avg(n) AS mean FROM base) GROUP BY 1",
    f"base AS (SELECT doc_id, greatest(1, length(text) // 6) AS n, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda t: t IN ({IN_TERMS})) AS hits FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda t: t IN ({IN_TERMS}))) > 0), tf AS (SELECT doc_id, n, token, count(*) AS tf FROM (SELECT doc_id, n, unnest(hits) AS token FROM base) GROUP BY 1, 2, 3)",
)
PATH_WEIGHTS = {"large": 2.0, "brand4": 1.5, "src": 1.0}
add(
    "path_bm25",
    lambda g: rt.bm25_of_paths(g, PATH_WEIGHTS),
    "nodes",
    "SELECT file_path, round(sum(CASE token WHEN 'large' THEN 2.0E0 WHEN 'brand4' THEN 1.5E0 ELSE 1.0E0 END * ln(1 + (docs - df + 0.5E0) / (df + 0.5E0)) * tf * 2.5E0 / (tf + 1.5E0 * (1 - 0.75E0 + 0.75E0 * n / mean))), 6) AS score FROM tf JOIN (SELECT token, count(*) AS df FROM tf GROUP BY 1) USING (token) CROSS JOIN (SELECT count(*) AS docs, avg(len(p)) AS mean FROM f) GROUP BY 1",
    "f AS (SELECT file_path, list_filter(string_split(regexp_replace(lower(file_path), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS p FROM (SELECT DISTINCT file_path FROM nodes)), tf AS (SELECT file_path, len(p) AS n, token, count(*) AS tf FROM (SELECT file_path, p, unnest(p) AS token FROM f) WHERE token IN ('large', 'brand4', 'src') GROUP BY 1, 2, 3)",
)
add(
    "function_bm25",
    lambda g: rt.bm25_in_files(g, {"red": 2.0, "plate": 1.0, "none": 0.5}),
    "nodes",
    "SELECT file_path, id, round(s / max(s) OVER (PARTITION BY file_path), 6) AS score FROM (SELECT file_path, id, sum(CASE token WHEN 'red' THEN 2.0E0 WHEN 'plate' THEN 1.0E0 ELSE 0.5E0 END * ln(1 + (docs - df + 0.5E0) / (df + 0.5E0)) * tf * 2.5E0 / (tf + 1.5E0 * (1 - 0.75E0 + 0.75E0 * n / mean))) AS s FROM tf JOIN (SELECT file_path, token, count(*) AS df FROM tf GROUP BY 1, 2) USING (file_path, token) JOIN (SELECT file_path, count(*) AS docs, avg(len(p)) AS mean FROM f GROUP BY 1) USING (file_path) GROUP BY 1, 2)",
    "f AS (SELECT file_path, id, string_split(regexp_replace(lower(concat_ws(' ', name, return_type)), '[^a-z0-9]+', ' ', 'g'), ' ') AS p FROM nodes WHERE label IN ('Function', 'Method')), tf AS (SELECT file_path, id, len(p) AS n, token, count(*) AS tf FROM (SELECT file_path, id, p, unnest(p) AS token FROM f) WHERE token IN ('red', 'plate', 'none') GROUP BY 1, 2, 3, 4)",
)
add(
    "reranked_files",
    lambda g: rt.reranked_by_edges(g, called_files(g).select(F.col("key").alias("file_path"), "score")),
    "nodes edges",
    "SELECT file_path, round(n * (1 + 0.5E0 * inc / m), 6) AS score, inc AS incoming FROM (SELECT t.file_path, t.n, coalesce(i.inc, 0) AS inc, max(coalesce(i.inc, 0)) OVER () AS m FROM top10 t LEFT JOIN (SELECT target_file AS file_path, count(*) AS inc FROM fe WHERE target_file IN (SELECT file_path FROM top10) AND source_file IN (SELECT file_path FROM top10) GROUP BY 1) i USING (file_path)) WHERE m > 0 ORDER BY score DESC, file_path LIMIT 5",
    f"{DEG}, {FE}, top10 AS (SELECT * FROM deg ORDER BY n DESC, file_path LIMIT 10)",
)
add(
    "augmented_query",
    lambda g: rt.augmented_query(g, issues(g), "id", F.col("text")),
    "nodes",
    "SELECT id, token, round(max(2 * ln((1 + total) / CAST(1 + df AS DOUBLE)) / ln(1 + total)), 6) AS weight FROM w JOIN (SELECT token, count(*) AS df FROM (SELECT DISTINCT file_path, {0} AS token FROM nodes) GROUP BY 1 UNION ALL SELECT lower(name), count(*) FROM nodes GROUP BY 1) USING (token) CROSS JOIN (SELECT count(*) AS total FROM nodes) GROUP BY 1, 2".replace("{0}", STEM.format("file_path")),
    ISSUES + ", w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z_]{3,}')) AS token FROM issues)",
)
add(
    "stem_scores",
    lambda g: rt.stem_scores(g, g.spark.createDataFrame([("large", 2.0), ("small", 1.0), ("nothing", 9.0)], "token string, weight double")),
    "nodes",
    f"SELECT DISTINCT file_path, CASE {STEM.format('file_path')} WHEN 'large' THEN 1.0E0 ELSE 0.5E0 END AS score FROM nodes WHERE {STEM.format('file_path')} IN ('large', 'small')",
)
add(
    "merged_anchors",
    lambda g: rt.merged_anchors(g.nodes.where("id % 3 = 0").groupBy("file_path").agg((F.max(F.col("id") % 10) / 10).alias("score")), g.nodes.where("id % 50 = 0").select("file_path").distinct(), g.nodes.where("id % 20 = 0").select("file_path").distinct()),
    "nodes",
    "SELECT file_path, CASE WHEN l AND w <> '' THEN concat(w, '+lexical') WHEN l THEN 'lexical' ELSE w END AS reason, y OR (s AND l) AS trusted FROM (SELECT *, CASE WHEN s AND y THEN 'both' WHEN s THEN 'semantic' WHEN y THEN 'symbol' ELSE '' END AS w FROM (SELECT file_path, coalesce(max(CASE WHEN id % 3 = 0 THEN id % 10 END) / 10.0E0 >= 0.3E0, false) AS s, bool_or(id % 50 = 0) AS y, bool_or(id % 20 = 0) AS l FROM nodes GROUP BY 1)) WHERE s OR y OR l",
)
add(
    "commit_memory",
    lambda g: rt.commit_memory(commits(g), g.commit_files.select("commit_id", "file_path"), ["low", "f"], [FILE]),
    "commit_files",
    f"SELECT file_path, round(sum(s), 6) AS score FROM commit_files JOIN (SELECT commit_id, (len(list_intersect(list_distinct(string_split(regexp_replace(lower(subject), '[^a-z0-9]+', ' ', 'g'), ' ')), ['low', 'f'])) + 1.5E0 * CASE WHEN commit_id IN (SELECT commit_id FROM commit_files WHERE file_path = '{FILE}') THEN 1 ELSE 0 END) / ln(place + 3) AS s FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, commit_id DESC) - 1 AS place FROM commits) WHERE place < 300) USING (commit_id) WHERE s > 0 GROUP BY 1 ORDER BY sum(s) DESC, file_path LIMIT 20",
    COMMITS,
)
add(
    "cochange_expansion",
    lambda g: rt.cochange_expansion(g.commit_files, [FILE], 2000, 1),
    "commit_files",
    f"SELECT file_path, count(DISTINCT commit_id) AS n, round(count(DISTINCT commit_id) / CAST((SELECT count(DISTINCT commit_id) FROM r WHERE file_path = '{FILE}') AS DOUBLE), 6) AS coupling FROM r WHERE commit_id IN (SELECT commit_id FROM r WHERE file_path = '{FILE}') AND regexp_replace(file_path, '/[^/]*$', '') <> 'src/brand4' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "r AS (SELECT * FROM commit_files WHERE commit_id IN (SELECT commit_id FROM (SELECT DISTINCT commit_id, ts FROM commit_files) ORDER BY ts DESC, commit_id DESC LIMIT 2000))",
)
add(
    "recency_boost",
    lambda g: rt.boosted(called_files(g).select(F.col("key").alias("file_path"), F.col("score").cast("double").alias("score")), g.nodes.groupBy("file_path").agg((F.max("id") % 20 / 10).alias("weight")).where("weight > 0.5")),
    "nodes edges",
    "SELECT file_path, round(n * (1 + least(coalesce(w, 0.0E0), 1.0E0) * (1.3E0 - 1)), 6) AS score FROM deg LEFT JOIN (SELECT file_path, max(id) % 20 / 10.0E0 AS w FROM nodes GROUP BY 1 HAVING max(id) % 20 / 10.0E0 > 0.5E0) USING (file_path)",
    DEG,
)
add(
    "provenance_tags",
    lambda g: rt.provenance(g.nodes.select("file_path").distinct(), *[g.nodes.where(f"id % {n} = 0").select("file_path") for n in (11, 13, 17, 19)]),
    "nodes",
    "SELECT file_path, concat_ws(',', CASE WHEN bool_or(id % 11 = 0) THEN 'issue-symbol' END, CASE WHEN bool_or(id % 13 = 0) THEN 'stack-frame' END, CASE WHEN bool_or(id % 17 = 0) THEN 'graph-neighbor' END, CASE WHEN starts_with(file_path, 'tests/') THEN 'test-of' END, CASE WHEN bool_or(id % 19 = 0) THEN 'recent-edit' END) AS tags FROM nodes GROUP BY 1",
)
add("position_scores", lambda g: rt.position_scores(called_files(g).orderBy(F.desc("score"), "key").limit(20), "key", [F.desc("score"), "key"]), "nodes edges", "SELECT file_path AS key, round(1.0E0 / row_number() OVER (ORDER BY n DESC, file_path), 6) AS score FROM deg QUALIFY row_number() OVER (ORDER BY n DESC, file_path) <= 20", DEG)
add("term_relevance", lambda g: rk.term_relevance(g.table("documents"), "doc_id", F.col("text"), ["license", "und", "pour"]), "", "SELECT doc_id, hits, round(hits / 3.0E0, 6) AS relevance FROM (SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'und') AS INT) + CAST(contains(lower(text), 'pour') AS INT) AS hits FROM documents) WHERE hits > 0")
add("blend_a", lambda g: rk.blended(_joined(g), "A"), "nodes edges", "SELECT key, round(0.25E0 / 0.6E0 * semantic + 0.35E0 / 0.6E0 * lexical, 6) AS score FROM j", GRAPH)
add("blend_b", lambda g: rk.blended(_joined(g), "B"), "nodes edges", "SELECT key, round(0.8E0 * reach + 0.2E0 * proximity, 6) AS score FROM j", GRAPH)
add("blend_c", lambda g: rk.blended(_joined(g), "C"), "nodes edges", "SELECT key, round(e - CASE WHEN e < 0.1E0 THEN 0.1E0 * hub ELSE 0.0E0 END, 6) AS score FROM (SELECT key, hub, 0.25E0 * semantic + 0.35E0 * lexical + 0.2E0 * reach * (1 - hub) + 0.05E0 * proximity AS e FROM j)", GRAPH)


def _lists(g: Graph) -> DataFrame:
    a = called_files(g).withColumn("signal", F.lit("calls"))
    return a.unionByName(sized_files(g).withColumn("signal", F.lit("size"))).select("key", "signal", F.col("score").cast("double").alias("score"))


LISTS = "l AS (SELECT file_path AS key, 'calls' AS signal, CAST(n AS DOUBLE) AS score FROM deg UNION ALL SELECT file_path, 'size', CAST(n AS DOUBLE) FROM siz)"
FUSE = "SELECT key, round(sum(CASE signal WHEN 'calls' THEN 2.0E0 ELSE 1.0E0 END / (60 + rank)), 6) AS score, count(*) AS signals FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, key) AS rank FROM {} WHERE score > 0) GROUP BY 1 ORDER BY sum(CASE signal WHEN 'calls' THEN 2.0E0 ELSE 1.0E0 END / (60 + rank)) DESC, key LIMIT {}"
add("fused_files", lambda g: rk.fused_files(_lists(g), {"calls": 2.0}), "nodes edges", FUSE.format("l", 50), f"{DEG}, {SIZED}, {LISTS}")
add(
    "fused_twice",
    lambda g: rk.fused_twice(_lists(g), {"calls": 2.0}, lk.file_edges(g).select(F.col("source_file").alias("key"), F.col("target_file").alias("to")).distinct()),
    "nodes edges",
    FUSE.format("l2", 100),
    f"{DEG}, {SIZED}, {FE}, {LISTS}, f1 AS ({FUSE.format('l', 100)}), top AS (SELECT key, score FROM f1 ORDER BY score DESC, key LIMIT 10), l2 AS (SELECT * FROM l UNION ALL SELECT target_file, 'carried', max(score) FROM top JOIN (SELECT DISTINCT source_file, target_file FROM fe) ON source_file = key GROUP BY 1)",
)
add(
    "caller_proximity",
    lambda g: rk.caller_proximity(g.edges.where("type = 'CALLS'"), ranked_files(g)),
    "nodes edges",
    "SELECT target_id, max(CASE WHEN rank <= 10 THEN 0.3E0 WHEN rank <= 50 THEN 0.1E0 ELSE 0.0E0 END) AS proximity FROM edges JOIN (SELECT file_path, row_number() OVER (ORDER BY n DESC, file_path) AS rank FROM deg QUALIFY rank <= 100) r ON r.file_path = source_file WHERE type = 'CALLS' GROUP BY 1",
    DEG,
)


def ranked_files(g: Graph) -> DataFrame:
    return tx.ranked(called_files(g), "calls", "score", "key").select(F.col("key").alias("file_path"), "rank")


RANKS = "r AS (SELECT file_path, row_number() OVER (ORDER BY n DESC, file_path) AS rank FROM deg QUALIFY rank <= 100)"
add("rank_tiers", lambda g: rk.tiers(ranked_files(g)), "nodes edges", "SELECT file_path, rank, CASE WHEN rank <= 3 THEN 'VERIFIED' WHEN rank <= 5 THEN 'WARNING' ELSE 'INFO' END AS tier FROM r", f"{DEG}, {RANKS}")


def _own(g: Graph) -> DataFrame:
    return called_files(g).select("key", (F.col("score") % 100 / 100).alias("score"))


def _agent(g: Graph) -> DataFrame:
    return sized_files(g).where("key LIKE '%large%'").select("key", (F.col("score") % 9 / 9).alias("score"))


OWN = "own AS (SELECT file_path AS key, n % 100 / 100.0E0 AS score FROM deg), agent AS (SELECT file_path AS key, n % 9 / 9.0E0 AS score FROM siz WHERE file_path LIKE '%large%')"
add("governed_rank", lambda g: rk.governed(_own(g), _agent(g)), "nodes edges", "SELECT key, round(greatest(a, b, 0.55E0 * a + 0.45E0 * b), 6) AS score FROM (SELECT key, coalesce(own.score, 0.0E0) AS a, coalesce(agent.score, 0.0E0) AS b FROM own FULL JOIN agent USING (key)) ORDER BY 2 DESC, 1 LIMIT 10", f"{DEG}, {SIZED}, {OWN}")
add("expansion_rule", lambda g: rk.should_expand(_own(g)), "nodes edges", "SELECT max(score) - min(score) <= 0.05E0 AS expand FROM (SELECT score FROM own ORDER BY score DESC, key LIMIT 3)", f"{DEG}, {SIZED}, {OWN}")
add(
    "bounded_union",
    lambda g: rk.bounded_union(ranked_files(g).withColumnRenamed("file_path", "key"), ranked_files(g).where("rank % 2 = 0").select(F.col("file_path").alias("key"), (F.col("rank") / 2).cast("int").alias("rank")), 5, 8, 9),
    "nodes edges",
    "SELECT key, row_number() OVER (ORDER BY side, rank, key) AS place FROM (SELECT file_path AS key, 0 AS side, rank FROM r WHERE rank <= 5 UNION ALL SELECT file_path, 1, rank // 2 FROM r WHERE rank % 2 = 0 AND rank // 2 <= 8 AND rank > 5) QUALIFY place <= 9",
    f"{DEG}, {RANKS}",
)
add(
    "tiered_schedule",
    lambda g: rk.scheduled(g.nodes.select(F.col("file_path").alias("task"), F.col("id").alias("key"), (F.col("id") % 3 + 1).alias("tier"), (F.col("id") % 17).alias("score"), (F.col("id") % 4 == 0).alias("confirmed"))),
    "nodes",
    "SELECT task, key, place FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY e, score DESC, key) AS place FROM (SELECT file_path AS task, id AS key, id % 17 AS score, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 4 = 0 THEN 1 ELSE 2 + id % 3 END AS e FROM nodes)) WHERE place <= 5 OR (place <= 7 AND e <= 1)",
)
add(
    "disambiguation",
    lambda g: rk.disambiguated(g.nodes.join(g.nodes.groupBy("name").agg(F.count(F.lit(1)).alias("homonyms")), "name").select("name", "id", (F.col("id") % 2).alias("name_match"), (F.col("id") % 5 / 5).alias("module_match"), "homonyms", (F.col("id") % 10 / 10).alias("centrality"))),
    "nodes",
    "SELECT name, id, score, CASE WHEN score >= 0.7E0 AND NOT coalesce(score - nxt < 0.15E0, false) THEN 'VERIFIED' WHEN score >= 0.4E0 THEN 'WARNING' ELSE 'INFO' END AS tier FROM (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM (SELECT name, id, round(0.3E0 * (id % 2) + 0.4E0 * (id % 5 / 5.0E0) + 0.2E0 / count(*) OVER (PARTITION BY name) + 0.1E0 * (id % 10 / 10.0E0), 6) AS score FROM nodes) WINDOW w AS (PARTITION BY name ORDER BY score DESC, id)) WHERE k = 1",
)
add(
    "budget_lines",
    lambda g: rk.greedy_lines(g.nodes.select(F.col("file_path").alias("task"), F.col("id").alias("place"), F.col("qualified_name").alias("text")), 40),
    "nodes",
    """SELECT task, s % 100000 AS kept, n - s % 100000 AS suppressed, s // 100000 AS used FROM (
SELECT file_path AS task, count(*) AS n, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(length(qualified_name) // 4 AS BIGINT) ORDER BY id)), lambda s, t: CASE WHEN s // 100000 + t <= 40 THEN s + t * 100000 + 1 ELSE s END) AS s FROM nodes GROUP BY 1)""",
)
