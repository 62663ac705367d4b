"""Calls and imports of parsed files resolved to nodes, relations between classes, routes and modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import directory
from ..sources.shared import stored
from .resolution import name_match_confidence

#: The steps of the cascade with their method, confidence and evidence; name_match takes its confidence from the candidates.
STEPS = [
    (1, "same_file", 1.0, "same_file"),
    (2, "import", 1.0, "ast_import"),
    (3, "import", 1.0, "ast_import"),
    (4, "import", 0.95, "ast_import"),
    (5, "import", 0.85, "ast_import"),
    (6, "verified_unique", 0.95, "unique_name"),
    (7, "type_flow", 0.90, "receiver_type"),
    (8, "name_match", None, "name_match"),
]
CLASSES = ("Class", "Interface", "Struct")


def aliases(files: DataFrame) -> DataFrame:
    """Names by which modules are imported (alias, target_file): suffixes of each path, with dots and with slashes, and of
    its folder where the file is a package's own."""
    bare = F.regexp_replace(F.regexp_replace("file_path", r"\.[A-Za-z]+$", ""), r"/(__init__|index|mod)$", "")
    parts = F.split(bare, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.slice(parts, k, F.size(parts)))
    rows = files.select("file_path").distinct().select(F.col("file_path").alias("target_file"), F.explode(tails).alias("_t"))
    return rows.select("target_file", F.explode(F.array_distinct(F.array(F.array_join("_t", "."), F.array_join("_t", "/")))).alias("alias"))


def absolute_module(file_path: Column, module: Column) -> Column:
    """A module's path where it is given relative to the importing file (``./x``, ``../x``, ``.x``, ``..x``); others as they are."""
    slashed = module.rlike(r"^\.\.?/")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.when(slashed, module).otherwise(F.concat(F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise("./"), F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))))
    steps = F.split(F.concat(directory(file_path), F.lit("/"), rest), "/")
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.when(slashed | module.startswith("."), F.array_join(folded, "/")).otherwise(module)


def import_index(imports: DataFrame, known: DataFrame) -> DataFrame:
    """What imported names may stand for: file_path, imported_name, target_file.

    ``known``: :func:`aliases`. The module itself counts first; where it is no file, its name below it (``module.name``).
    """
    i = imports.select("file_path", "imported_name", absolute_module(F.col("file_path"), F.regexp_replace("module_path", "::", ".")).alias("m")).distinct()
    direct = i.join(known, F.col("m") == F.col("alias")).select("file_path", "imported_name", "m", "target_file")
    missed = i.join(direct.select("file_path", "imported_name", "m"), ["file_path", "imported_name", "m"], "left_anti")
    below = missed.withColumn("m2", F.explode(F.array(F.concat_ws(".", "m", "imported_name"), F.concat_ws("/", "m", "imported_name"))))
    nested = below.join(known, F.col("m2") == F.col("alias")).select("file_path", "imported_name", "m", "target_file")
    return direct.unionByName(nested).select("file_path", "imported_name", "target_file").where("file_path <> target_file").distinct()


def through_reexports(index: DataFrame, nodes: DataFrame, hops: int = 3) -> DataFrame:
    """The index with names followed on through files that import them, or everything, and don't define them.

    Chains have ``hops`` steps at most; a file that was reached already is not entered again, so cycles stop.
    """
    defined = nodes.select(F.col("file_path").alias("target_file"), F.col("name").alias("imported_name")).distinct()
    keys = ["file_path", "imported_name", "target_file"]
    index = stored(index.select(*keys), "reexports")
    reached, open_ = [index], index.where("imported_name <> '*'")
    on = index.select(F.col("file_path").alias("_at"), F.col("imported_name").alias("_as"), F.col("target_file").alias("_next"))
    for _ in range(hops):
        lacking = open_.join(defined, ["target_file", "imported_name"], "left_anti").withColumn("_as", F.explode(F.array("imported_name", F.lit("*"))))
        further = lacking.join(on, (F.col("target_file") == F.col("_at")) & (lacking["_as"] == on["_as"])).select("file_path", "imported_name", F.col("_next").alias("target_file")).where("file_path <> target_file").distinct()
        for table in reached:  # one by one: their union would be broadcast by the size of its files
            further = further.join(table, keys, "left_anti")
        open_ = stored(further, "reexports")
        if open_.isEmpty():
            break
        reached.append(open_)
    return reduce(DataFrame.unionByName, reached).distinct()


def _first(nodes: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Of the nodes of each key (column: its name here) how many there are, the smallest id and the one after it."""
    named = nodes.select(F.col("id"), *[F.col(c).alias(k) for c, k in keys.items()])
    least = named.groupBy(*keys.values()).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_one"))
    after = named.join(least.select(*keys.values(), "_one"), list(keys.values())).where("id > _one").groupBy(*keys.values()).agg(F.min("id").alias("_two"))
    return least.join(after, list(keys.values()), "left")


def _two(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """The smallest id of each key and the one after it, as columns of a step."""
    rows = stored(rows.select(*keys, "id"), "resolve-candidates")
    least = rows.groupBy(*keys).agg(F.min("id").alias(f"_one{step}"))
    after = rows.join(least, keys).where(F.col("id") > F.col(f"_one{step}")).groupBy(*keys).agg(F.min("id").alias(f"_two{step}"))
    return least.join(after, keys, "left")


def _but_self(step: int | str = "") -> Column:
    """The smallest candidate that isn't the caller; null if there is none."""
    return F.when(F.col(f"_one{step}") != F.col("caller_id"), F.col(f"_one{step}")).otherwise(F.col(f"_two{step}"))


def _earliest(found: dict[int, Column]) -> Column:
    """Step and target of the first step that found one."""
    return F.coalesce(*[F.when(target.isNotNull(), F.struct(F.lit(step).alias("step"), target.alias("target_id"))) for step, target in found.items()])


def resolve(calls: DataFrame, nodes: DataFrame, index: DataFrame) -> DataFrame:
    """Edges of calls (file_path, caller_id, callee_name, callee_qualified, line), by the first step that knows the callee.

    1: the file's one node of the name. 2: a node of the name in a file from which it, or everything, is imported. 3: one in
    the file that the receiver's name is imported from. 4: the method of an imported class. 5: the one class that has such
    a method, where the file imports anything. 6: the graph's one node of the name. 7: the method of the class that the
    receiver names. 8: any node of the name. Of several candidates the smallest id holds. A step never finds the caller
    itself. Of calls between the same ends the first line is kept.

    Names are followed through files that re-export them. Every step finds the two smallest candidates once for all calls of
    a name in a file (or by a receiver), so that a call meets one row a step, however many nodes and imports share its name;
    steps from the third on look for calls that are still open. Null names resolve to nothing.
    """
    index = stored(through_reexports(index, nodes), "resolve-index")
    c = calls.select("file_path", "caller_id", "callee_name", "callee_qualified", "line").distinct()
    c = c.withColumn("receiver", F.regexp_extract("callee_qualified", r"^(.+)\.\w+$", 1))
    c = stored(c.withColumn("head", F.substring_index("receiver", ".", 1)), "resolve-calls")
    n = nodes.select("id", F.col("name").alias("_name"), "label", F.col("parent_id").alias("_class"))
    classes = nodes.where(F.col("label").isin(*CLASSES)).select(F.col("id").alias("_class"), F.col("name").alias("_cname"), F.col("file_path").alias("_cfile"), F.col("label").alias("_clabel"))
    methods = n.where("_class IS NOT NULL AND label IN ('Method', 'Function')").join(classes, "_class").select("id", "_name", "_cname", "_cfile", "_clabel")
    by_name = stored(_first(nodes, {"name": "callee_name"}), "resolve-names")
    by_file = stored(_first(nodes, {"name": "callee_name", "file_path": "_file"}), "resolve-names")
    in_file = by_file.select("callee_name", "_file", F.explode(F.array_compact(F.array("_one", "_two"))).alias("id"))
    by = index.select(F.col("file_path"), "imported_name", F.col("target_file").alias("_file"))
    # by file and name: the file's own node, and those of files that the name or everything is imported from
    named = ["file_path", "callee_name"]
    here = by_file.where("_n = 1").select(F.col("_file").alias("file_path"), "callee_name", F.col("_one").alias("_here"))
    asked = c.select(*named).distinct().withColumn("imported_name", F.explode(F.array("callee_name", F.lit("*"))))
    files = asked.join(by, ["file_path", "imported_name"]).select(*named, "_file").distinct()
    step2 = _two(files.join(in_file, ["callee_name", "_file"]), named, 2)
    near = c.join(here.join(step2, named, "full"), named, "left")
    near = stored(near.withColumn("b", _earliest({1: F.when(F.col("_here") != F.col("caller_id"), F.col("_here")), 2: _but_self(2)})).select(*c.columns, "b"), "resolve-near")
    rest = near.where("b IS NULL").drop("b")
    # by file, receiver's first name and name: nodes of files that the receiver is imported from
    received = ["file_path", "head", "callee_name"]
    asked = rest.where("receiver <> ''").select(*received).distinct()
    step3 = _two(asked.join(by.withColumnRenamed("imported_name", "head"), ["file_path", "head"]).join(in_file, ["callee_name", "_file"]), received, 3)
    # by file and name: methods of imported classes
    wanted = stored(rest.select(*named).distinct(), "resolve-wanted")
    of_class = methods.select("id", F.col("_name").alias("callee_name"), F.col("_cname").alias("imported_name"), F.col("_cfile").alias("_file")).join(wanted.select("callee_name").distinct(), "callee_name", "left_semi")
    imported = by.where("imported_name <> '*'").join(wanted.select("file_path").distinct(), "file_path", "left_semi").join(of_class, ["imported_name", "_file"])
    step4 = _two(imported.join(wanted, named, "left_semi"), named, 4)
    only = methods.where("_clabel IN ('Class', 'Struct')").groupBy(F.col("_name").alias("callee_name")).agg(F.count(F.lit(1)).alias("_methods"), F.min("id").alias("_only")).where("_methods = 1")
    importing = index.select("file_path").distinct().withColumn("_imports", F.lit(True))
    by_receiver = ["receiver", "callee_name"]
    step7 = _two(methods.select("id", F.col("_cname").alias("receiver"), F.col("_name").alias("callee_name")).join(rest.select(*by_receiver).distinct(), by_receiver, "left_semi"), by_receiver, 7)
    callers = nodes.select(F.col("id").alias("caller_id"), F.col("name").alias("_own"))
    far = rest.join(step3, received, "left").join(step4, named, "left").join(only, "callee_name", "left").join(importing, "file_path", "left").join(step7, by_receiver, "left").join(by_name, "callee_name", "left").join(callers, "caller_id", "left")
    far = far.withColumn("candidates", F.col("_n") - F.coalesce((F.col("_own") == F.col("callee_name")).cast("int"), F.lit(0)))
    late = {
        3: _but_self(3), 4: _but_self(4), 5: F.when(F.col("_imports") & (F.col("_only") != F.col("caller_id")), F.col("_only")), 6: F.when(F.col("candidates") == 1, _but_self()),
        7: _but_self(7), 8: F.when(F.col("candidates") > 1, _but_self()),
    }
    columns = ["caller_id", "file_path", "line", "b.target_id", "b.step", "candidates"]
    found = near.withColumn("candidates", F.lit(None).cast("long")).select(*columns).unionByName(far.withColumn("b", _earliest(late)).select(*columns)).where("target_id IS NOT NULL")
    one = found.groupBy("caller_id", "target_id").agg(F.min(F.struct("line", "step", "candidates", "file_path")).alias("f"))
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in STEPS]), F.col("f.step"))
    match = F.col("f.step") == 8
    return one.select(
        F.col("caller_id").alias("source_id"),
        "target_id",
        F.lit("CALLS").alias("type"),
        F.col("f.line").alias("source_line"),
        F.col("f.file_path").alias("source_file"),
        pick(1).alias("resolution_method"),
        F.when(match, name_match_confidence(F.col("f.candidates"))).otherwise(pick(2)).alias("confidence"),
        F.when(~match, "CERTIFIED").when(F.col("f.candidates") == 2, "CANDIDATE").otherwise("SPECULATIVE").alias("trust_tier"),
        F.when(match, F.col("f.candidates")).otherwise(F.lit(1)).cast("int").alias("candidate_count"),
        pick(3).alias("evidence_type"),
    )


def nearest_by_path(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each (file_path, name) the node of the name whose path shares most leading folders, 100 more for the same folder; ties to the smallest id."""
    n = nodes.select(F.col("id").alias("node_id"), "name", F.col("file_path").alias("_file"))
    a, b = F.split(directory(F.col("file_path")), "/"), F.split(directory(F.col("_file")), "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    depth = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]
    score = depth + F.when(directory(F.col("file_path")) == directory(F.col("_file")), 100).otherwise(0)
    scored = wanted.join(n, "name").withColumn("score", score)
    return scored.groupBy("file_path", "name").agg(F.max_by(F.struct("node_id", "score"), F.struct("score", -F.col("node_id"))).alias("b")).select("file_path", "name", "b.node_id", "b.score")


def class_named(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each (file_path, name) a class or interface of the name: the file's own, else of the smallest id."""
    c = nodes.where(F.col("label").isin(*CLASSES)).select(F.col("id").alias("node_id"), "name", F.col("file_path").alias("_file"))
    own = c.groupBy(F.col("_file").alias("file_path"), "name").agg(F.min("node_id").alias("_own"))
    first = c.groupBy("name").agg(F.min("node_id").alias("_first"))
    return wanted.distinct().join(first, "name").join(own, ["file_path", "name"], "left").select("file_path", "name", F.coalesce("_own", "_first").alias("node_id"))


def relationships(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations that lines (file_path, language, line, text, indent) state: source_id, target_id, type, source_line, confidence.

    EXTENDS and IMPLEMENTS from heads of classes, HANDLES_ROUTE from a decorator to the next definition's file anchor,
    COMPOSES from capitalised tags to the component's node. Names are bound by :func:`class_named`.
    """
    text = F.col("text")
    name = F.regexp_extract(text, r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", 1)
    python = F.regexp_extract(text, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1)
    extends = F.when(F.col("language") == "python", python).otherwise(F.regexp_extract(text, r"\bextends\s+([\w.]+)", 1))
    implements = F.regexp_extract(text, r"\bimplements\s+([\w., ]+?)\s*\{?\s*$", 1)
    heads = rows.where(name != "").select("file_path", "line", name.alias("_own"), F.explode(F.concat(F.transform(F.split(extends, ","), lambda x: F.struct(F.trim(x).alias("name"), F.lit("EXTENDS").alias("type"), F.lit(0.95).alias("confidence"))), F.transform(F.split(implements, ","), lambda x: F.struct(F.trim(x).alias("name"), F.lit("IMPLEMENTS").alias("type"), F.lit(0.9).alias("confidence"))))).alias("r"))
    heads = heads.select("file_path", "line", "_own", F.substring_index("r.name", ".", -1).alias("name"), "r.type", "r.confidence").where("name <> '' AND name <> 'object' AND NOT contains(name, '=')")
    bound = heads.join(class_named(heads.select("file_path", "name").distinct(), nodes), ["file_path", "name"])
    own = nodes.where(F.col("label").isin(*CLASSES)).select("file_path", F.col("name").alias("_own"), F.col("id").alias("source_id"))
    inherits = bound.join(own, ["file_path", "_own"]).select("source_id", F.col("node_id").alias("target_id"), "type", F.col("line").alias("source_line"), "confidence").where("source_id <> target_id")
    # a route decorator holds for the next definition of its file
    along = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    route = F.regexp_extract(text, r"^\s*@\w+\.(?:route|get|post|put|delete|patch)\(\s*['\"]([^'\"]+)", 1)
    plain = F.when(route != "", F.struct(route.alias("r"), F.lit(0).alias("d"))).when(text.rlike(r"^\s*(async\s+)?def\s"), F.struct(F.lit("").alias("r"), F.lit(1).alias("d")))
    marked = rows.withColumn("_r", F.last(plain, True).over(along))
    handlers = marked.where(text.rlike(r"^\s*(async\s+)?def\s") & (F.col("_r.r") != "")).select("file_path", "line")
    starts = nodes.select("file_path", F.col("start_line").alias("line"), F.col("id").alias("source_id"))
    anchor = nodes.groupBy("file_path").agg(F.min_by("id", F.struct("start_line", "id")).alias("target_id"))
    handles = handlers.join(starts, ["file_path", "line"]).join(anchor, "file_path").select("source_id", "target_id", F.lit("HANDLES_ROUTE").alias("type"), F.col("line").alias("source_line"), F.lit(0.9).alias("confidence"))
    tags = rows.where(F.col("language").isin("javascript", "typescript")).select("file_path", "line", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"<([A-Z]\w*)[\s/>]"), F.lit(1)))).alias("name"))
    parts = nodes.groupBy("name").agg(F.min("id").alias("target_id"))
    composes = tags.join(parts, "name").join(anchor.withColumnRenamed("target_id", "source_id"), "file_path").where("source_id <> target_id").select("source_id", "target_id", F.lit("COMPOSES").alias("type"), F.col("line").alias("source_line"), F.lit(0.85).alias("confidence"))
    return inherits.unionByName(handles).unionByName(composes)


def serialization_pairs(nodes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Functions of one file and parent whose names differ by a pair of parts (to and from, encode and decode, ...), both ways.

    The parts are taken out of both names, and what is left is joined. A pair that several parts or both orders give is kept
    for the first alone, as told from the two rows, so that no table of pairs has to be made distinct.
    """
    low, rows = F.lower("name"), []
    for i, (a, b) in enumerate(pairs):
        for side, part in enumerate((a, b)):
            rows.append(F.when(F.contains(low, F.lit(part)), F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.replace(low, F.lit(part), F.lit("*")).alias("rest"))))
    n = nodes.where("label IN ('Function', 'Method')").select("id", "file_path", F.coalesce("parent_id", F.lit(0)).alias("parent"), F.array_compact(F.array(*rows)).alias("_all"))
    n = n.select("id", "file_path", "parent", "_all", F.explode("_all").alias("r")).select("id", "file_path", "parent", "_all", "r.*")
    left, right = n.where("side = 0"), n.where("side = 1").withColumnRenamed("id", "_other").withColumnRenamed("_all", "_others")
    sooner = lambda x: (x["i"] < F.col("i")) | ((x["i"] == F.col("i")) & (x["side"] == 1) & (F.col("id") > F.col("_other")))
    again = F.exists("_all", lambda x: sooner(x) & F.exists("_others", lambda y: (y["i"] == x["i"]) & (y["side"] != x["side"]) & (y["rest"] == x["rest"])))
    both = left.join(right, ["file_path", "parent", "i", "rest"]).where(~again).select("id", F.col("_other").alias("other_id"))
    return both.unionByName(both.where("id <> other_id").select(F.col("other_id").alias("id"), F.col("id").alias("other_id"))).withColumn("confidence", F.lit(0.8))


def verified_edges(edges: DataFrame, definitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unsure edges (edge_id, target_id) against the definitions that a language server names (edge_id, file, name, line).

    The node is the one of the name, in a file that ends with the server's, around the line; the latest start holds. verified:
    the same target; corrected: another; deleted: none. Edges without an answer are left out.
    """
    n = nodes.select(F.col("id").alias("_node"), "name", "file_path", "start_line", "end_line")
    found = definitions.join(n, "name").where(F.col("file_path").endswith(F.col("file")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = found.groupBy("edge_id").agg(F.max_by("_node", F.struct("start_line", -F.col("_node"))).alias("_node"))
    joined = edges.join(definitions.select("edge_id").distinct(), "edge_id").join(best, "edge_id", "left")
    outcome = F.when(F.col("_node").isNull(), "deleted").when(F.col("_node") == F.col("target_id"), "verified").otherwise("corrected")
    return joined.select("edge_id", outcome.alias("outcome"), F.coalesce("_node", "target_id").alias("target_id"))
