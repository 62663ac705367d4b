"""Replacing files of a stored graph in one step: what pointed into them is bound anew, and readers see all of it or nothing.

The tables are those of ``store.SCHEMAS`` in versions: nodes by file, edges by source, properties and assertions by node.
Empty ``files`` change nothing. Names that are null bind to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from ..sources.versions import Versions
from .resolution import name_match_confidence
from .store import numbered

#: Key of each table.
KEYS = {"nodes": "file_path", "edges": "source_id", "properties": "node_id", "assertions": "test_node_id"}


def create(versions: Versions, tables: dict[str, DataFrame]) -> int:
    """The first version of a graph."""
    for name, df in tables.items():
        versions.put(name, df, KEYS[name])
    return versions.commit()


def rebound(incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges into replaced files (with target_file and target_name), bound by name to the files' new nodes.

    One candidate keeps a method of same_file or import with its confidence (1 if that was under a half); else it is a match
    by name, by the number of candidates. The smallest id is taken. Edges without a candidate are left out.
    """
    found = nodes.groupBy(F.col("file_path").alias("target_file"), F.col("name").alias("target_name")).agg(F.count(F.lit(1)).cast("int").alias("_n"), F.min("id").alias("_target"))
    kept = (F.col("_n") == 1) & F.col("resolution_method").isin("same_file", "import")
    tier = F.when(kept | (F.col("_n") == 1), "CERTIFIED").when(F.col("_n") == 2, "CANDIDATE").otherwise("SPECULATIVE")
    joined = incoming.join(found, ["target_file", "target_name"])
    confidence = F.when(kept, F.when(F.coalesce("confidence", F.lit(0.0)) < 0.5, 1.0).otherwise(F.col("confidence"))).otherwise(name_match_confidence(F.col("_n")))
    return joined.select("source_id", F.col("_target").alias("target_id"), "type", "source_line", "source_file", F.when(kept, F.col("resolution_method")).otherwise("name_match").alias("resolution_method"), confidence.alias("confidence"), tier.alias("trust_tier"), F.col("_n").alias("candidate_count"))


def replace_files(versions: Versions, files: DataFrame, nodes: DataFrame, edges_of: Callable[[DataFrame], DataFrame] | None = None, facts_of: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, int]:
    """Puts ``nodes`` (of files in ``files``, without ids) in place of what the files had, in one new version.

    Snapshot, delete, insert, rebind: edges from other files into the files are kept and bound by name to the new nodes;
    all else of the files goes. ``edges_of`` gives the new nodes' own edges, ``facts_of`` their properties or assertions,
    each from the nodes with their ids. Returns how many rows were deleted and inserted, and edges restored and dropped.
    """
    files = stored(files.select("file_path").distinct(), "replace-files")
    old = versions.read("nodes")
    gone = stored(old.join(files, "file_path", "left_semi").select(F.col("id").alias("_gone"), F.col("file_path").alias("target_file"), F.col("name").alias("target_name")), "replace-gone")
    first = (old.agg(F.max("id")).first()[0] or 0) + 1
    new = stored(numbered(nodes.join(files, "file_path", "left_semi"), ["file_path", "start_line", "name"], first), "replace-nodes")
    edges = versions.read("edges")
    # edges of the files, and those into them: read by their two ends only
    ends = edges.select("source_id", "target_id")
    own = gone.select("_gone").distinct()
    sources = ends.join(own, F.col("target_id") == F.col("_gone"), "left_semi").select("source_id").union(own)
    at = versions.touched("edges", sources)
    touched = versions.read("edges", at) if at else edges.limit(0)
    from_files = touched.join(own, F.col("source_id") == F.col("_gone"), "left_semi")
    from_others = touched.join(own, F.col("source_id") == F.col("_gone"), "left_anti")
    incoming = stored(from_others.join(gone, F.col("target_id") == F.col("_gone")).drop("_gone"), "replace-incoming")
    kept = from_others.join(own, F.col("target_id") == F.col("_gone"), "left_anti")
    bound = stored(rebound(incoming, new), "replace-bound")
    added = edges_of(new) if edges_of else None
    names = [c for c in edges.columns if c != "id"]
    fresh = bound.select(*names) if added is None else bound.select(*names).unionByName(added.select(*names))
    if "id" in edges.columns:
        top = (edges.agg(F.max("id")).first()[0] or 0) + 1
        fresh = numbered(fresh, ["source_id", "target_id", "type"], top)
    fresh = stored(fresh, "replace-edges")
    counts = {"nodes_deleted": gone.count(), "nodes_inserted": new.count(), "edges_deleted": from_files.count() + incoming.count(), "edges_restored": bound.count()}
    counts |= {"edges_dropped": incoming.count() - counts["edges_restored"], "edges_inserted": fresh.count() - counts["edges_restored"]}
    into = sorted({*at, *versions.touched("edges", fresh.select("source_id"))})
    whole = versions.read("edges", [b for b in into if b not in set(at)]).unionByName(kept) if set(into) - set(at) else kept
    versions.rewrite("edges", whole.unionByName(fresh.select(*edges.columns)), into)
    for name, key in (("properties", "node_id"), ("assertions", "test_node_id")):
        if name in versions.tables:
            extra = stored(facts_of[name](new), f"replace-{name}") if facts_of and name in facts_of else None
            ids = own if extra is None else own.union(extra.select(key))
            parts = versions.touched(name, ids)
            left = versions.read(name, parts).join(own, F.col(key) == F.col("_gone"), "left_anti")
            versions.rewrite(name, left if extra is None else left.unionByName(extra.select(*left.columns)), parts)
    parts = versions.touched("nodes", files)
    versions.rewrite("nodes", versions.read("nodes", parts).join(files, "file_path", "left_anti").unionByName(new.select(*old.columns)), parts)
    versions.commit()
    return counts
