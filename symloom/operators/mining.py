"""Rules, majorities, contradictions and findings over nodes' properties and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import levenshtein_similarity, parameter_count
from ..sources.graph import Graph


def _groups(g: Graph) -> DataFrame:
    """Functions without a parent by their file: (id, grp)."""
    return g.nodes.where("parent_id IS NULL AND label = 'Function'").select("id", F.col("file_path").alias("grp"))


def property_majorities(g: Graph, least: int = 3) -> DataFrame:
    """For each file and kind of property the commonest value of its functions, ties to the smallest, with its share."""
    p = g.properties.select("node_id", "kind", "value").join(_groups(g), F.col("node_id") == F.col("id"))
    v = p.groupBy("grp", "kind", "value").agg(F.countDistinct("node_id").alias("n"))
    t = p.groupBy("grp", "kind").agg(F.countDistinct("node_id").alias("total"))
    best = v.groupBy("grp", "kind").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("b"))
    return best.join(t, ["grp", "kind"]).where(F.col("total") >= least).select("grp", "kind", F.col("b.value").alias("value"), F.col("b.n").alias("n"), "total", F.round(F.col("b.n") / F.col("total"), 6).alias("share"))


def sibling_outliers(g: Graph, share: float = 0.4) -> DataFrame:
    """Functions whose value of a kind differs from their file's majority."""
    m = property_majorities(g).where(F.col("share") >= share).select("grp", F.col("kind").alias("k"), F.col("value").alias("usual"), "share")
    p = g.properties.select("node_id", "kind", "value").join(_groups(g), F.col("node_id") == F.col("id")).drop("id")
    return p.join(m, ["grp"]).where("kind = k AND value <> usual").select("node_id", "kind", "value", "usual", "share")


def mined_rules(g: Graph, least: int = 3, support: float = 0.8) -> DataFrame:
    """Kinds of properties that most functions of a file have."""
    m = _groups(g)
    size = m.groupBy("grp").agg(F.count(F.lit(1)).alias("functions")).where(F.col("functions") >= least)
    have = g.properties.select("node_id", "kind").distinct().join(m, F.col("node_id") == F.col("id")).groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("n"))
    return have.join(size, "grp").where(F.col("n") >= support * F.col("functions")).select("grp", "kind", F.concat(F.col("n").cast("string"), F.lit("/"), F.col("functions").cast("string")).alias("frequency"))


def class_conventions(g: Graph, share: float = 0.7) -> DataFrame:
    """Files in which one return type dominates."""
    c = g.nodes.where("label IN ('Function', 'Method')").groupBy("file_path", "return_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("file_path")
    best = c.withColumn("total", F.sum("n").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("n"), "return_type"))).where("_k = 1")
    return best.where(F.col("n") > share * F.col("total")).select("file_path", "return_type", "n", "total")


def call_site_votes(g: Graph, least: int = 3) -> DataFrame:
    """For each callee the commonest type of its callers and how sure that is, less what the names resemble."""
    s = g.nodes.select(F.col("id").alias("source_id"), F.col("return_type").alias("value"))
    t = g.nodes.select(F.col("id").alias("target_id"), F.col("return_type").alias("own"))
    v = g.edges.where("type = 'CALLS'").join(s, "source_id").groupBy("target_id", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("target_id")
    best = v.withColumn("total", F.sum("n").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("n"), "value"))).where((F.col("_k") == 1) & (F.col("total") >= least))
    return best.join(t, "target_id").select("target_id", "value", F.round(F.col("n") / F.col("total") * (1 - levenshtein_similarity(F.col("value"), F.col("own"))), 6).alias("confidence"))


def guard_rates(g: Graph, least: int = 3) -> DataFrame:
    """Share of each node's callers that have a guard clause."""
    guarded = g.properties.where("kind = 'guard_clause'").select(F.col("node_id").alias("source_id")).distinct().withColumn("guarded", F.lit(1.0))
    e = g.edges.where("type = 'CALLS'").join(guarded, "source_id", "left")
    r = e.groupBy("target_id").agg(F.count(F.lit(1)).alias("sites"), F.avg(F.coalesce("guarded", F.lit(0.0))).alias("rate")).where(F.col("sites") >= least)
    return r.select("target_id", "sites", F.round("rate", 6).alias("rate"), F.round(F.least(F.col("rate") * 0.85, F.lit(0.85)), 6).alias("confidence"))


def contracts(g: Graph) -> DataFrame:
    """Contracts of functions: a value returned, many callers, no side effects."""
    f = g.nodes.where("label IN ('Function', 'Method')")
    kinds = lambda k: g.properties.where(F.col("kind") == k).select(F.col("node_id").alias("id")).distinct()
    callers = g.edges.where("type = 'CALLS'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 10").select("id")
    row = lambda df, name, c: df.select("id", F.lit(name).alias("contract"), F.lit(c).alias("confidence"))
    returns = f.where("return_type NOT IN ('', 'None')")
    pure = f.join(kinds("side_effect"), "id", "left_anti")
    return row(returns, "returns_value", 0.9).unionByName(row(f.join(callers, "id", "left_semi"), "many_callers", 0.95)).unionByName(row(pure, "pure", 0.85))


def similar_siblings(g: Graph, least: float = 0.3) -> DataFrame:
    """For each method the sibling with the most callees in common, by Jaccard similarity."""
    m = g.nodes.where("parent_id IS NOT NULL").select("id", "parent_id")
    c = g.edges.where("type = 'CALLS'").join(m, F.col("source_id") == F.col("id")).select("id", "parent_id", "target_id")
    n = c.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    pairs = c.alias("a").join(c.alias("b"), (F.col("a.parent_id") == F.col("b.parent_id")) & (F.col("a.target_id") == F.col("b.target_id")) & (F.col("a.id") != F.col("b.id")))
    both = pairs.groupBy(F.col("a.id").alias("id"), F.col("b.id").alias("sibling")).agg(F.count(F.lit(1)).alias("both"))
    j = both.join(n, "id").join(n.select(F.col("id").alias("sibling"), F.col("n").alias("m")), "sibling")
    return j.select("id", "sibling", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("similarity")).where(F.col("similarity") >= least)


def override_violations(g: Graph) -> DataFrame:
    """Nodes along EXTENDS edges between functions of different arity."""
    s = g.nodes.select(F.col("id").alias("source_id"), "label", parameter_count(F.col("signature")).alias("params"))
    t = g.nodes.select(F.col("id").alias("target_id"), F.col("label").alias("base_label"), parameter_count(F.col("signature")).alias("base_params"))
    e = g.edges.where("type = 'EXTENDS'").join(s, "source_id").join(t, "target_id")
    return e.where("label = base_label AND params <> base_params").select("source_id", "target_id", "params", "base_params")


def arity_mismatches(g: Graph) -> DataFrame:
    """Sure calls from a function of no parameters into one of many."""
    s = g.nodes.select(F.col("id").alias("source_id"), parameter_count(F.col("signature")).alias("given"))
    t = g.nodes.select(F.col("id").alias("target_id"), parameter_count(F.col("signature")).alias("wanted"))
    return g.edges.where("type = 'CALLS' AND confidence >= 0.9").join(s, "source_id").join(t, "target_id").where("given = 0 AND wanted > 5").select("source_id", "target_id", "given", "wanted")


def moved_imports(g: Graph, edges: DataFrame | None = None) -> DataFrame:
    """Imports of a name that its folder doesn't hold, with the first file elsewhere that does."""
    n = g.nodes.select("name", "file_path", F.regexp_replace("file_path", "/[^/]*$", "").alias("dir"))
    wanted = (g.edges if edges is None else edges).where("type = 'IMPORTS'").join(g.nodes.select(F.col("id").alias("target_id"), "name"), "target_id").select("source_file", "name").distinct().withColumn("dir", F.regexp_replace("source_file", "/[^/]*$", ""))
    gone = wanted.join(n.select("name", "dir").distinct(), ["name", "dir"], "left_anti")
    first = n.groupBy("name").agg(F.min("file_path").alias("found_in"))
    return gone.join(first, "name").select("source_file", "name", "found_in")


def findings(g: Graph) -> DataFrame:
    """Contradictions of several kinds in one shape: kind, subject, other, confidence."""
    o = override_violations(g).select(F.lit("override").alias("kind"), F.col("source_id").alias("subject"), F.col("target_id").alias("other"), F.lit(0.9).alias("confidence"))
    a = arity_mismatches(g).select(F.lit("arity").alias("kind"), F.col("source_id").alias("subject"), F.col("target_id").alias("other"), F.lit(0.85).alias("confidence"))
    r = guard_rates(g).where("rate >= 0.75").select(F.lit("guard").alias("kind"), F.col("target_id").alias("subject"), F.lit(0).cast("long").alias("other"), "confidence")
    return o.unionByName(a).unionByName(r)


def pruned(found: DataFrame, least: float = 0.7, per_kind: int = 3) -> DataFrame:
    """The surest findings of each kind."""
    order = Window.partitionBy("kind").orderBy(F.desc("confidence"), "subject", "other")
    return found.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_kind)


def abstention(found: DataFrame) -> DataFrame:
    """By subject: hard with a contradiction of much evidence, soft with some, else nothing is said."""
    s = found.groupBy("subject").agg(F.count(F.lit(1)).alias("evidence"), F.max("confidence").alias("confidence"))
    return s.select("subject", "evidence", F.when((F.col("evidence") >= 2) & (F.col("confidence") >= 0.85), "hard").when(F.col("confidence") >= 0.7, "soft").otherwise("none").alias("policy"))


def name_shingles(g: Graph, least: float = 0.6) -> DataFrame:
    """Pairs of names whose sets of three characters are alike, joined by shared ones."""
    n = g.nodes.select("name").distinct().where(F.length("name") >= 3)
    s = n.select("name", F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(F.col("name"), i, F.lit(3)))).alias("s"))
    e = s.select("name", F.size("s").alias("n"), F.explode("s").alias("x"))
    both = e.alias("a").join(e.alias("b"), (F.col("a.x") == F.col("b.x")) & (F.col("a.name") < F.col("b.name"))).groupBy(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.count(F.lit(1)).alias("both"))
    return both.select("name_a", "name_b", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("similarity")).where(F.col("similarity") >= least)


def select_within_budget(rows: DataFrame, budget: int = 450, per_family: int = 2) -> DataFrame:
    """Greedy choice by target: rows (target, family, score, tokens) by score, few of a family, skipping what no longer fits.

    The choice depends on its order, so a target's rows, which are few after the family limit, are gone through together.
    """
    order = Window.partitionBy("target", "family").orderBy(F.desc("score"), "tokens")
    few = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_family).drop("_k")

    # sorted by score falling, family and tokens, what is null or no number last
    key = [F.isnull("score") | F.isnan("score"), -F.col("score"), F.isnull("family"), F.col("family"), F.isnull("tokens"), F.col("tokens")]
    each = few.groupBy("target").agg(F.sort_array(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], F.struct(*few.columns).alias("row")))).alias("_all"))
    kept = F.slice("_all", 1, 0)
    start = F.struct(F.lit(budget).cast("double").alias("left"), kept.alias("kept"))
    fits = lambda s, x: F.coalesce(x["row"]["tokens"] <= s["left"], F.lit(False))
    step = lambda s, x: F.when(fits(s, x), F.struct((s["left"] - x["row"]["tokens"]).alias("left"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    return each.select(F.explode(F.aggregate("_all", start, step)["kept"]).alias("x")).select("x.row.*")
