"""The registry of queries and their SQL, and what several of them share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graph import Graph, from_tables
from .projection_sql import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, build: Callable[[Graph], DataFrame], views: str = "", sql: str | None = None, more: str = "") -> None:
    """Registers a query and, where SQL can express it, its oracle."""
    QUERIES[name] = lambda spark, path: build(from_tables(spark, path))
    if sql is not None:
        ORACLE[name] = oracle(views, sql, more)


def sparse(g: Graph) -> DataFrame:
    """The fixture's thinned edges (FIXTURES.md, B.4), for queries whose SQL reads the view of that name."""
    return g.edges.where((F.col("source_id") * 31 + F.col("target_id")) % 37 == 0)


def add_both(name: str, build: Callable[[Graph, DataFrame], DataFrame], views: str, sql: str, more: str = "") -> None:
    """Registers a query over the thinned edges that its SQL reads, and ``name``_whole over all edges with the same SQL over these."""
    whole = lambda text: re.sub(r"\bsparse\b", "edges", text)
    add(name, lambda g: build(g, sparse(g)), views, sql, more)
    add(f"{name}_whole", lambda g: build(g, g.edges), whole(views), whole(sql), whole(more))


#: Tables of expressions that several oracles share.
FILE_EDGES = "fe AS (SELECT e.source_file, t.file_path AS target_file, e.type, e.confidence FROM {} e JOIN nodes t ON t.id = e.target_id WHERE e.source_file <> t.file_path)"
FE, SFE = FILE_EDGES.format("edges"), FILE_EDGES.format("sparse")
PARAMS = "(CASE WHEN trim(regexp_extract(signature, '\\(([^()]*)\\)', 1)) = '' THEN 0 ELSE len(string_split(regexp_extract(signature, '\\(([^()]*)\\)', 1), ',')) END)"
WEIGHT = "(CASE type WHEN 'CALLS' THEN 1.0E0 WHEN 'IMPORTS' THEN 0.8E0 WHEN 'EXTENDS' THEN 0.9E0 WHEN 'USES' THEN 0.5E0 ELSE 0.3E0 END)"
GATE = "confidence >= 0.5E0 AND resolution_method IN ('same_file', 'import', 'name_match')"
DEGREE = "deg AS (SELECT t.file_path, count(*) AS degree FROM edges e JOIN nodes t ON t.id = e.target_id WHERE e.type = 'CALLS' GROUP BY 1)"
