"""The query surface: one object over a graph that answers a user's questions with DataFrames.

Every method is a composition of the operators; nothing is collected but where a method says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import is_critical
from .operators import aggregates as ag
from .operators import checks as ch
from .operators import lookups as lk
from .operators import retrieval as rt
from .operators import symbols as sy
from .operators import traversal as gr
from .sources.graph import Graph

#: Words that lead a question to an operation, in order.
ROUTES = [
    ("impact", ("impact", "break", "affect", "blast")),
    ("trace", ("trace", "call", "chain", "flow")),
    ("dead_code", ("dead", "unused", "never used")),
    ("hotspots", ("hot", "most used", "central")),
    ("validate", ("valid", "check", "correct")),
    ("symbols", ("symbols in", "what is in", "list")),
    ("find_relevant", ("where", "find", "relevant", "fix", "bug", "issue")),
]


@dataclass
class Engine:
    """Questions about one graph."""

    graph: Graph

    def find_relevant(self, text: str, most: int = 10, depth: int = 2) -> DataFrame:
        """Files for a task's text: those with names whose parts are all in it, and what imports connect with them.

        Scores halve with each hop; files with such a name count half as much more. The seeds, ``most`` files at most, are
        few; all edges are walked.
        """
        words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]
        seeds = self._named(words).limit(most)
        walked = gr.bfs_files(self.graph, seeds.select("file_path"), depth)
        scored = walked.join(seeds.withColumnRenamed("names", "_names"), "file_path", "left")
        score = F.pow(F.lit(0.5), F.col("distance")) * F.when(F.col("_names").isNotNull(), 1.5).otherwise(1.0)
        return scored.withColumn("score", F.round(score, 6)).where("score >= 0.2").orderBy(F.desc("score"), "file_path").limit(most).select("file_path", "distance", "score")

    def _named(self, words: list[str]) -> DataFrame:
        from .operators.text import symbol_anchors

        return symbol_anchors(self.graph, words, 1000)

    def symbols(self, file_path: str) -> DataFrame:
        """Symbols of a file with their uses, by line."""
        return sy.symbols(self.graph).where(F.col("file_path") == file_path).orderBy("line_number", "id")

    def trace(self, symbol: str) -> DataFrame:
        """Callers, symbol and callees of each node of a name."""
        return sy.dependency_chain(self.graph, symbol)

    def impact(self, symbol: str) -> DataFrame:
        """Calls of the nodes of a name from other files, with the risk that a change breaks them."""
        ids = self.graph.nodes.where(F.col("name") == symbol).select(F.col("id").alias("target_id"))
        return sy.caller_risks(self.graph).join(ids, "target_id", "left_semi")

    def explain(self, symbol: str) -> DataFrame:
        """Nodes of a name with uses, best facts and tests that call them."""
        tests = lk.tests_for(self.graph).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("tests"))
        facts = lk.contract_pivot(self.graph).withColumnRenamed("node_id", "id")
        own = lk.by_name(self.graph, symbol)
        return own.join(facts, "id", "left").join(tests, "id", "left").withColumn("tests", F.coalesce("tests", F.lit(0)))

    def context(self, symbol: str, most: int = 10) -> DataFrame:
        """Where the nodes of a name are referred to, surest first."""
        ids = self.graph.nodes.where(F.col("name") == symbol).select(F.col("id").alias("symbol_id"))
        return sy.references(self.graph, 0.5).join(ids, "symbol_id", "left_semi").orderBy("referenced_in_file", "referenced_at_line", "symbol_id").limit(most)

    def brief(self, text: str, most: int = 5) -> DataFrame:
        """Symbols for an intent with a warning where they are much used or critical."""
        words = rt.issue_tokens(F.lit(text), 3, 5)
        tokens = self.graph.spark.range(1).select(F.explode(words).alias("token"))  # five words at most
        names = sy.symbols(self.graph).withColumn("token", F.explode(F.split(F.lower("name"), "_")))
        hits = names.join(F.broadcast(tokens), "token").groupBy("id", "name", "file_path", "usage_count").agg(F.count(F.lit(1)).alias("hits"))
        warning = F.when(is_critical(F.col("file_path")), "critical path").when(F.col("usage_count") >= 20, "many users").otherwise("")
        return hits.orderBy(F.desc("hits"), F.desc("usage_count"), "id").limit(most).select("id", "name", "file_path", "usage_count", warning.alias("warning"))

    def validate(self, imports: DataFrame) -> DataFrame:
        """Imports (file_path, module_path, imported_name) with verdicts, and suggestions for names that no node has."""
        checked = ch.checked_imports(self.graph, imports)
        known = self.graph.nodes.select(F.col("name").alias("imported_name")).distinct()
        unknown = checked.where("verdict IN ('unknown', 'misspelt')").join(known, "imported_name", "left_anti")
        near = ch.suggested(unknown.select(F.col("imported_name").alias("name")), self.graph).select(F.col("name").alias("imported_name"), F.col("suggestion").alias("_s"))
        joined = checked.join(near, "imported_name", "left")
        return joined.select("file_path", "module_path", "imported_name", "verdict", F.when(F.col("suggestion") != "", F.col("suggestion")).otherwise(F.coalesce("_s", F.lit(""))).alias("suggestion"))

    def orient(self, most: int = 5) -> DataFrame:
        """An overview: the largest folders, most used files and hotspots, in one table of (section, name, n)."""
        part = lambda df, section, name, n: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(n).cast("long").alias("n"))
        folders = part(sy.top_directories(self.graph, most), "folder", "dir", "files")
        entries = lk.usage(self.graph).join(self.graph.nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.sum("usage_count").alias("n")).orderBy(F.desc("n"), "file_path").limit(most)
        hot = self.hotspots(most)
        return folders.unionByName(part(entries, "entry", "file_path", "n")).unionByName(part(hot, "hotspot", "name", "usage_count"))

    def status(self) -> DataFrame:
        return ag.store_stats(self.graph)

    def hotspots(self, most: int = 10) -> DataFrame:
        """The most used nodes outside of tests."""
        n = self.graph.nodes.where("NOT is_test").join(lk.usage(self.graph), "id")
        return n.orderBy(F.desc("usage_count"), "id").limit(most).select("id", "name", "file_path", "usage_count")

    def dead_code(self) -> DataFrame:
        return lk.dead_code(self.graph)

    def unused_packages(self, packages: DataFrame) -> DataFrame:
        return sy.unused_packages(self.graph, packages)

    def patterns(self, files: DataFrame, patterns: dict[str, str]) -> DataFrame:
        return ch.pattern_shares(files, patterns)

    def review(self, diffs: DataFrame, most_by_kind: int = 3) -> DataFrame:
        """Findings of unified diffs (diff_id, diff): callers of functions that they change or remove, few of each kind."""
        from pyspark.sql.window import Window

        broken = ch.broken_callers(self.graph, ch.diff_lines(diffs))
        found = broken.select("diff_id", F.concat(F.col("status"), F.lit("_signature")).alias("kind"), "name", "caller_id", F.when(F.col("status") == "removed", 0.9).otherwise(0.8).alias("confidence"))
        rank = F.row_number().over(Window.partitionBy("diff_id", "kind").orderBy(F.desc("confidence"), "name", "caller_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= most_by_kind)

    def ask(self, question: str, subject: str) -> DataFrame:
        """Answers a question about a symbol, file or text (``subject``) by the operation that its words lead to."""
        name = route(question)
        if name == "validate":
            raise ValueError("validate needs a table of imports")
        return getattr(self, name)() if name in ("dead_code", "hotspots") else getattr(self, name)(subject)


def route(question: str) -> str:
    """The operation that a question's words lead to; find_relevant where none does."""
    low = question.lower()
    return next((name for name, words in ROUTES if any(w in low for w in words)), "find_relevant")
