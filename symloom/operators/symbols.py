"""Symbols, references, packages and files: views over the graph, lookups, joins of files and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ADMISSIBLE, directory, risk_tag
from ..sources.graph import Graph
from .lookups import file_edges, gate, usage

#: Kinds of symbols by label, types of references by type of edge (others are calls).
KINDS = {"Function": "function", "Method": "method", "Class": "class", "Struct": "class", "Interface": "interface", "Enum": "enum", "Type": "type", "File": "variable", "Constant": "variable", "Field": "property"}
REFERENCES = {"CALLS": "call", "IMPORTS": "import", "DEFINES": "call", "INHERITS": "type_usage", "IMPLEMENTS": "type_usage"}


def _mapped(column: str, values: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def symbols(g: Graph) -> DataFrame:
    """The nodes as symbols: id, name, kind, file_path, line_number, end_line, is_exported, signature, usage_count."""
    kind = _mapped("label", KINDS, F.lower("label"))
    return g.nodes.join(usage(g), "id", "left").select("id", "name", kind.alias("kind"), "file_path", F.col("start_line").alias("line_number"), "end_line", "is_exported", "signature", F.coalesce("usage_count", F.lit(0)).alias("usage_count"))


def references(g: Graph, least: float = 0.0) -> DataFrame:
    """The edges as references: symbol_id, referenced_in_file, referenced_at_line, reference_type."""
    kind = _mapped("type", REFERENCES, F.lit("call"))
    return g.edges.where(F.col("confidence") >= least).select(F.col("target_id").alias("symbol_id"), F.col("source_file").alias("referenced_in_file"), F.col("source_line").alias("referenced_at_line"), kind.alias("reference_type"))


def target_nodes(g: Graph, wanted: DataFrame) -> DataFrame:
    """The node that each of ``wanted`` (wanted_file, wanted_name, null for the file's most called) names.

    First the file itself, then files of the same base name; among several the one with most incoming calls, then the
    smallest id.
    """
    n = g.nodes.join(usage(g, "CALLS"), "id", "left").select("id", "name", "file_path", F.coalesce("usage_count", F.lit(0)).alias("callers"), F.substring_index("file_path", "/", -1).alias("base"))
    w = wanted.withColumn("_base", F.substring_index("wanted_file", "/", -1))
    found = w.join(n, (F.col("_base") == F.col("base")) & (F.col("wanted_name").isNull() | (F.col("wanted_name") == F.col("name"))))
    found = found.withColumn("exact", F.col("file_path") == F.col("wanted_file"))
    order = Window.partitionBy("wanted_file", "wanted_name").orderBy(F.desc("exact"), F.desc("callers"), "id")
    return found.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("wanted_file", "wanted_name", F.col("id").alias("node_id"), "callers", "exact")


def search(g: Graph, text: str, labels: tuple[str, ...], class_name: str | None = None, in_file: str | None = None, most: int = 20) -> DataFrame:
    """Nodes of some labels whose name holds a text (case left out), in a class or file on demand; the first by name, file, line."""
    found = g.nodes.where(F.col("label").isin(*labels) & F.lower("name").contains(text.lower()))
    if class_name is not None:
        owners = g.nodes.where(F.lower("name") == class_name.lower()).select(F.col("id").alias("parent_id"))
        found = found.join(owners, "parent_id", "left_semi")
    if in_file is not None:
        found = found.where(F.col("file_path").endswith(in_file))
    return found.orderBy("name", "file_path", "start_line", "id").limit(most).select("id", "name", "label", "file_path", "start_line")


def callers_with_code(g: Graph, lines: DataFrame, per_target: int = 3) -> DataFrame:
    """For each node callers of other files, one a file, with the text of the calling line (file_path, line, text)."""
    target = g.nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("_file"))
    e = g.edges.where((F.col("type") == "CALLS") & gate(0.5, ADMISSIBLE)).join(target, "target_id").where("source_file <> _file")
    one = e.groupBy("target_id", "source_file").agg(F.min("source_line").alias("line"))
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy("line", "source_file"))
    top = one.withColumn("rank", rank).where(F.col("rank") <= per_target)
    code = lines.select(F.col("file_path").alias("source_file"), "line", F.trim("text").alias("code"))
    return top.join(code, ["source_file", "line"], "left").select("target_id", "source_file", "line", F.coalesce("code", F.lit("")).alias("code"))


def callees_of_file(g: Graph) -> DataFrame:
    """Distinct nodes that each file refers to: file_path, symbol_id."""
    return g.edges.select(F.col("source_file").alias("file_path"), F.col("target_id").alias("symbol_id")).distinct()


def imports_of(g: Graph) -> DataFrame:
    """What each file imports: file_path, symbol, imported_from."""
    names = g.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("symbol"), F.col("file_path").alias("imported_from"))
    return g.edges.where("type = 'IMPORTS'").join(names, "target_id").select(F.col("source_file").alias("file_path"), "symbol", "imported_from").distinct()


def connected_files(g: Graph, path: str, terms: list[str], least: int = 1) -> DataFrame:
    """Files with a call to or from a file, that have at least so many of the terms in their path or names."""
    e = file_edges(g, g.edges.where("type = 'CALLS'"))
    near = e.where(F.col("target_file") == path).select(F.col("source_file").alias("file_path")).unionByName(e.where(F.col("source_file") == path).select(F.col("target_file").alias("file_path"))).distinct()
    names = g.nodes.groupBy("file_path").agg(F.collect_set(F.lower("name")).alias("names"))
    hit = lambda t: (F.lower("file_path").contains(t) | F.exists("names", lambda n: n.contains(t))).cast("int")
    found = near.join(names, "file_path").withColumn("overlap", sum((hit(t) for t in terms), F.lit(0)))
    return found.where(F.col("overlap") >= least).select("file_path", "overlap")


def nearest_candidate(g: Graph, files: DataFrame, candidates: list[str]) -> DataFrame:
    """For each file the first candidate that an edge connects with it, else the first of all."""
    e = file_edges(g)
    either = e.select("source_file", "target_file").unionByName(e.select(F.col("target_file").alias("source_file"), F.col("source_file").alias("target_file"))).distinct()
    places = F.create_map(*[x for i, c in enumerate(candidates) for x in (F.lit(c), F.lit(i))])
    hits = either.where(F.col("target_file").isin(*candidates)).groupBy(F.col("source_file").alias("file_path")).agg(F.min(F.try_element_at(places, F.col("target_file"))).alias("place"))
    best = F.coalesce(F.get(F.array(*[F.lit(c) for c in candidates]), F.col("place")), F.lit(candidates[0]))
    return files.join(hits, "file_path", "left").select("file_path", best.alias("candidate"), F.col("place").isNotNull().alias("connected"))


def exports_of(g: Graph, module: str) -> DataFrame:
    """Exported symbols of the files under a module's path."""
    return g.nodes.where(F.col("is_exported") & F.col("file_path").startswith(module)).select("id", "name", "file_path")


def match_symbols(g: Graph, text: str, most: int = 20) -> DataFrame:
    """Nodes that have all words of a text in name, path or signature, by id."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]
    tokens = F.split(F.regexp_replace(F.lower(F.concat_ws(" ", "name", "file_path", "signature")), "[^a-z0-9]+", " "), " ")
    return g.nodes.where(F.size(F.array_except(F.array(*[F.lit(w) for w in words]), tokens)) == 0).orderBy("id").limit(most).select("id", "name", "file_path")


def test_coimports(g: Graph, edges: DataFrame, seeds: list[str], most: int = 3) -> DataFrame:
    """Files of other folders that the tests of some files use too, by number of those tests."""
    tests = g.nodes.where("is_test").select(F.col("file_path").alias("source_file")).distinct()
    e = file_edges(g, edges).join(tests, "source_file", "left_semi").select("source_file", "target_file").distinct()
    mine = e.where(F.col("target_file").isin(*seeds)).select("source_file").distinct()
    folders = sorted({s.rsplit("/", 1)[0] for s in seeds})
    far = e.join(mine, "source_file", "left_semi").where(~F.col("target_file").isin(*seeds) & ~directory(F.col("target_file")).isin(*folders))
    return far.groupBy(F.col("target_file").alias("file_path")).agg(F.count(F.lit(1)).alias("tests")).orderBy(F.desc("tests"), "file_path").limit(most)


def unused_packages(g: Graph, packages: DataFrame) -> DataFrame:
    """Packages with whose name no import ends."""
    used = g.edges.where("type = 'IMPORTS'").join(g.nodes.select(F.col("id").alias("target_id"), "name"), "target_id").select("name").distinct()
    return packages.join(used, "name", "left_anti")


def unvisited(neighbours: DataFrame, visited: DataFrame) -> DataFrame:
    """Neighbours (file_path, other, ...) whose other file wasn't visited from this one (file_path, visited)."""
    return neighbours.join(visited.withColumnRenamed("visited", "other"), ["file_path", "other"], "left_anti")


def invented_imports(g: Graph, imports: DataFrame) -> DataFrame:
    """Imports (file_path, module_path, imported_name) from folders of the graph, of names that no node has."""
    local = g.nodes.select(F.explode(F.split(F.regexp_replace("file_path", r"\.[a-z]+$", ""), "/")).alias("_part")).distinct()
    near = imports.join(local, F.regexp_extract("module_path", r"^\.*([^./]+)", 1) == F.col("_part"), "left_semi").where("imported_name <> '*'")
    return near.join(g.nodes.select(F.col("name").alias("imported_name")).distinct(), "imported_name", "left_anti").select("file_path", "module_path", "imported_name")


def top_directories(g: Graph, most: int = 10) -> DataFrame:
    """Folders by their number of files, with the references into them."""
    files = g.nodes.select(directory(F.col("file_path")).alias("dir"), "file_path").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    into = g.edges.join(g.nodes.select(F.col("id").alias("target_id"), directory(F.col("file_path")).alias("dir")), "target_id").groupBy("dir").agg(F.count(F.lit(1)).alias("refs"))
    return files.join(into, "dir", "left").select("dir", "files", F.coalesce("refs", F.lit(0)).alias("refs")).orderBy(F.desc("files"), "dir").limit(most)


def module_symbols(g: Graph, coverage: DataFrame) -> DataFrame:
    """Symbols of each module of ``coverage`` (module_path, symbol_count): those in the graph, or those covered if more."""
    modules = coverage.select("module_path").where("module_path IS NOT NULL").distinct()
    # each file meets its beginnings of the lengths that modules have: one row of lengths, no more than a path is long
    lengths = modules.agg(F.collect_set(F.length("module_path")).alias("_lengths"))
    files = g.nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(lengths))
    beginnings = files.select(F.explode(F.filter("_lengths", lambda n: n <= F.length("file_path"))).alias("_l"), "file_path", "_n").select(F.substring(F.col("file_path"), F.lit(1), F.col("_l")).alias("module_path"), "_n")
    counts = beginnings.join(modules, "module_path", "left_semi").groupBy("module_path").agg(F.sum("_n").alias("n"))
    return coverage.join(counts, "module_path", "left").select("module_path", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("symbol_count", F.lit(0))).alias("symbols"))


def impact_radius(g: Graph) -> DataFrame:
    """Files that refer to any node of a name: name, files (their number), paths (sorted)."""
    e = g.edges.join(g.nodes.select(F.col("id").alias("target_id"), "name"), "target_id")
    return e.groupBy("name").agg(F.countDistinct("source_file").alias("files"), F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("paths"))


def caller_risks(g: Graph) -> DataFrame:
    """Each call of a node from another file with the risk that a change breaks it, and the node's level of impact.

    Calls resolved by name alone are unsure; several calls of a line's file are tight.
    """
    target = g.nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("_file"))
    e = g.edges.where("type = 'CALLS'").join(target, "target_id").where("source_file <> _file")
    per_file = e.groupBy("target_id", "source_file").agg(F.count(F.lit(1)).alias("calls"), F.max("confidence").alias("confidence"))
    risk = F.when((F.col("confidence") >= 0.9) & (F.col("calls") >= 2), "HIGH").when(F.col("confidence") >= 0.5, "MODERATE").otherwise("LOW")
    files = F.count(F.lit(1)).over(Window.partitionBy("target_id"))
    level = F.when(files >= 5, "HIGH").when(files >= 2, "MODERATE").otherwise("LOW")
    return per_file.select("target_id", "source_file", "calls", risk.alias("break_risk"), level.alias("level"))


def file_scores(node_scores: DataFrame, g: Graph) -> DataFrame:
    """Scores of nodes (id, score) summed by file, with the number of nodes."""
    return node_scores.join(g.nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("nodes"))


def exported_graph(g: Graph) -> DataFrame:
    """A row a file for display: uses, a JSON list of symbols, files imported from and by, and the share of dead exports as risk."""
    s = symbols(g)
    dead = F.avg((F.col("is_exported") & (F.col("usage_count") == 0)).cast("double"))
    entry = F.struct("id", "name", "kind", "usage_count")
    per_file = s.groupBy("file_path").agg(F.sum("usage_count").alias("uses"), F.to_json(F.array_sort(F.collect_list(entry))).alias("symbols"), F.round(dead, 6).alias("dead_share"))
    e = file_edges(g, g.edges.where("type = 'IMPORTS'"))
    listed = lambda key, other, name: e.groupBy(F.col(key).alias("file_path")).agg(F.array_join(F.array_sort(F.collect_set(other)), ",").alias(name))
    out = per_file.join(listed("source_file", "target_file", "imports_from"), "file_path", "left").join(listed("target_file", "source_file", "imported_by"), "file_path", "left")
    none = F.lit("")
    return out.select("file_path", "uses", "symbols", F.coalesce("imports_from", none).alias("imports_from"), F.coalesce("imported_by", none).alias("imported_by"), risk_tag(F.col("dead_share")).alias("risk"))


def symmetry_gaps(properties: DataFrame, left: str, right: str) -> DataFrame:
    """Values that a node has of one kind and not of another: node_id, missing (sorted), n."""
    sets = properties.where(F.col("kind").isin(left, right)).groupBy("node_id").agg(F.collect_set(F.when(F.col("kind") == left, F.substring_index("value", ":", -1))).alias("a"), F.collect_set(F.when(F.col("kind") == right, F.substring_index("value", ":", -1))).alias("b"))
    gaps = sets.withColumn("gap", F.array_sort(F.array_except("a", "b")))
    return gaps.where(F.size("gap") > 0).select("node_id", F.array_join("gap", ",").alias("missing"), F.size("gap").alias("n"))


def candidate_union(semantic: DataFrame, expanded: DataFrame, most: int) -> DataFrame:
    """Semantic candidates (key, score) and at most ``most`` that only the graph adds, by score: key, via."""
    extra = expanded.join(semantic.select("key"), "key", "left_anti").orderBy(F.desc("score"), "key").limit(most)
    both = semantic.join(expanded.select("key", F.lit(1).alias("_g")), "key", "left").select("key", F.when(F.col("_g") == 1, "both").otherwise("semantic").alias("via"))
    return both.unionByName(extra.select("key", F.lit("graph").alias("via")))


def seed_expansion(g: Graph, seeds: list[str], weights: dict[str, float], least: float = 0.5, most: int = 5) -> DataFrame:
    """Files one hop from the seeds in either direction by their weightiest edge, without hubs; the top ones."""
    e = file_edges(g, g.edges.where(F.col("confidence") >= least))
    kind = F.lit(0.3)
    for name, w in weights.items():
        kind = F.when(F.col("type") == name, w).otherwise(kind)
    e = e.withColumn("w", kind * F.col("confidence"))
    near = e.where(F.col("source_file").isin(*seeds)).select(F.col("target_file").alias("file_path"), "w").unionByName(e.where(F.col("target_file").isin(*seeds)).select(F.col("source_file").alias("file_path"), "w"))
    best = near.where(~F.col("file_path").isin(*seeds)).groupBy("file_path").agg(F.round(F.max("w"), 6).alias("weight"))
    degree = file_edges(g, g.edges.where("type = 'CALLS'")).groupBy(F.col("target_file").alias("file_path")).agg(F.count(F.lit(1)).alias("degree"))
    small = best.join(degree, "file_path", "left").where(F.tanh(F.coalesce("degree", F.lit(0)) / 1000.0) < 0.5)
    return small.orderBy(F.desc("weight"), "file_path").limit(most).select("file_path", "weight")


def import_dependents(g: Graph) -> DataFrame:
    """Nodes in files that import a node's file: node_id, dependent_id, weight."""
    e = file_edges(g, g.edges.where("type = 'IMPORTS'")).select("source_file", "target_file").distinct()
    own = g.nodes.select(F.col("id").alias("node_id"), F.col("file_path").alias("target_file"))
    other = g.nodes.where("is_exported").select(F.col("id").alias("dependent_id"), F.col("file_path").alias("source_file"))
    return own.join(e, "target_file").join(other, "source_file").select("node_id", "dependent_id", F.lit(0.5).alias("weight"))


def import_dependent_counts(g: Graph) -> DataFrame:
    """For each node the number of its :func:`import_dependents` and the smallest: node_id, dependents, first_id; by files, without the pairs."""
    e = file_edges(g, g.edges.where("type = 'IMPORTS'")).select("source_file", "target_file").distinct()
    exported = g.nodes.where("is_exported").groupBy(F.col("file_path").alias("source_file")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    of_file = e.join(exported, "source_file").groupBy("target_file").agg(F.sum("n").alias("dependents"), F.min("first").alias("first_id"))
    own = g.nodes.select(F.col("id").alias("node_id"), F.col("file_path").alias("target_file"))
    return own.join(of_file, "target_file").select("node_id", "dependents", "first_id")


def override_chain(g: Graph) -> DataFrame:
    """Methods of the same name in other files, by counts: id, name, others."""
    m = g.nodes.where("label = 'Method'")
    per_file = m.groupBy("name", "file_path").agg(F.count(F.lit(1)).alias("here"))
    total = m.groupBy("name").agg(F.count(F.lit(1)).alias("total"))
    return m.join(per_file, ["name", "file_path"]).join(total, "name").select("id", "name", (F.col("total") - F.col("here")).alias("others")).where("others > 0")


def shared_state(g: Graph) -> DataFrame:
    """Nodes of a file that read the same field: value, file_path, nodes (their number), ids (sorted)."""
    p = g.properties.where("kind = 'field_read'").join(g.nodes.select(F.col("id").alias("node_id"), "file_path"), "node_id")
    return p.groupBy("file_path", "value").agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), ",").alias("ids")).where("nodes > 1")


def dependency_chain(g: Graph, symbol: str, most: int = 4) -> DataFrame:
    """Caller, symbol and callees as one line for each node of a name: the first caller by id, the first callees by confidence."""
    n = g.nodes.where(F.col("name") == symbol).select("id", "name")
    names = g.nodes.select(F.col("id").alias("_i"), F.col("name").alias("_n"))
    e = g.edges.where("type = 'CALLS'")
    into = n.join(e, F.col("id") == F.col("target_id")).join(names, F.col("source_id") == F.col("_i")).groupBy("id").agg(F.min_by("_n", F.col("source_id")).alias("caller"))
    order = Window.partitionBy("source_id").orderBy(F.desc("confidence"), "target_id")
    out = e.join(n, F.col("id") == F.col("source_id")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most - 2).join(names, F.col("target_id") == F.col("_i"))
    out = out.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_n"))), lambda x: x["_n"]), " -> ").alias("callees"))
    joined = n.join(into, "id", "left").join(out, F.col("id") == F.col("source_id"), "left")
    return joined.select("id", F.concat_ws(" -> ", "caller", "name", "callees").alias("chain"))
