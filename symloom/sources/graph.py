"""The property graph as DataFrames: nodes, edges, properties, assertions, commits, interventions and texts.

:func:`from_tables` projects the driver's relational tables onto the graph model; :func:`from_parquet` reads a graph
that was stored under the same names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a bucket of the leading key by which edges are numbered.
ID_BUCKET = 1024
#: Rows of a task: tables of more are dealt to as many partitions by key, and nodes of more are never broadcast.
NODES_PER_TASK, LINES_PER_TASK = 50_000, 500_000
#: Small source files of a task.
FILES_PER_TASK = 2_500


#: Files of three languages; NAME, LIMIT, KEY and HELPER are filled in.
TEMPLATES = {
    "py": '''import os, sys
from lib.core import (
    alpha,
    beta as b,
)
TEXT = """
def ghost(): pass
"""
@login_required
async def NAME(
    a: str = "x, (y)",
    *rest,
) -> dict:
    """Doc of NAME.

    def hidden(): pass
    """
    if a == LIMIT:
        return None
    token = os.environ["KEY"]
    try:
        with open(a) as f:
            f.read()
            f.close()
    except (OSError, ValueError) as e:
        raise RuntimeError("bad # not a comment")
    async with Lock() as held:
        return HELPER(a, "call_in_string()")
''',
    "ts": """import {
  alpha,
  beta as b,
} from './core';
const quoted = "function ghost() {";
export const NAME = async (a: string, n = LIMIT) => {
  // function hidden() {
  if (n > LIMIT) {
    return null;
  }
  try {
    client.open(a);
    client.send(process.env.KEY);
  } catch (err) {
    throw new AppError(a);
  }
  await HELPER(a, `call_in_string(`);
};
""",
    "java": """package gen;
import lib.core.Alpha;
class Holder<T> {
    int size() { return count(); }
    <R> T NAME(Map<String, R> a,
            int n) throws IOException {
        String s = "void ghost() {";
        if (n < LIMIT) {
            return null;
        }
        synchronized (this) {
            store.open(a);
            store.close();
        }
        try (Reader r = HELPER(a)) {
            return tokenOf(System.getenv("KEY"));
        } catch (IOException e) {
            throw new IllegalStateException("x");
        }
    }
}
""",
}


@dataclass
class Graph:
    """Lazy tables of one graph; each is planned when first asked for."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _tasks(self, name: str, rows: int) -> int:
        """Partitions for a table, of ``rows`` rows each; its rows are counted by Parquet's footers."""
        return -(-self.table(name).count() // rows)

    @cached_property
    def _line_tasks(self) -> int:
        tasks = self._tasks("lineitem", LINES_PER_TASK)
        return max(tasks, self.spark.sparkContext.defaultParallelism) if tasks > 1 else tasks

    @cached_property
    def nodes(self) -> DataFrame:
        """The nodes. Of many a small file may stand for more memory than a broadcast has, so they are met by merging."""
        rows, tasks = self._projected_nodes, self._tasks("part", NODES_PER_TASK)
        return rows.repartition(tasks, "id").hint("merge") if tasks > 1 else rows

    @property
    def _projected_nodes(self) -> DataFrame:
        key = F.col("p_partkey")
        kind = F.when(key % 8 == 6, "Class").when(key % 8 == 7, "Interface").when((key % 8).isin(4, 5), "Method").otherwise("Function")
        name = F.replace("p_name", F.lit(" "), F.lit("_"))
        low_type, test = F.lower("p_type"), F.col("p_size") % 10 == 0
        arguments = F.when(key % 4 == 0, "()").when(key % 4 == 1, "(a)").when(key % 4 == 2, "(a, b)").otherwise("(a, b, c, d, e, f)")
        return self.table("part").select(
            (key.cast("long") + 1).alias("id"),
            kind.alias("label"),
            name.alias("name"),
            F.concat(low_type, F.lit("."), name).alias("qualified_name"),
            F.concat(F.when(test, "tests/").otherwise("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), low_type, F.lit(".py")).alias("file_path"),
            (key % 97 * 10 + 1).cast("int").alias("start_line"),
            (key % 97 * 10 + 1 + F.col("p_size")).cast("int").alias("end_line"),
            F.concat(name, arguments).alias("signature"),
            F.when(key % 3 == 0, "None").when(key % 3 == 1, F.col("p_type")).otherwise("").alias("return_type"),
            (F.col("p_size") % 4 != 0).alias("is_exported"),
            test.alias("is_test"),
            F.when(F.col("p_size") % 3 == 0, "python").when(F.col("p_size") % 3 == 1, "go").otherwise("typescript").alias("language"),
            F.when((key % 8).isin(4, 5), (key - key % 8 + 7).cast("long")).alias("parent_id"),
        )

    @cached_property
    def _plain_edges(self) -> DataFrame:
        """Edges without ids: one row for each source, target and type."""
        parts = self.table("part").agg(F.count(F.lit(1)).alias("parts"))
        line = F.col("l_linenumber")
        kind = F.when(line <= 4, "CALLS").when(line == 5, "IMPORTS").when(line == 6, "EXTENDS").otherwise("USES")
        raw = self.table("lineitem").crossJoin(F.broadcast(parts)).select(  # one row of counts
            (F.col("l_orderkey") % F.col("parts") + 1).alias("source_id"),
            (F.col("l_partkey") + 1).alias("target_id"),
            kind.alias("type"),
            F.col("l_quantity").cast("int").alias("source_line"),
            F.round(F.col("l_discount") * 100).cast("int").alias("d"),
            F.concat("l_returnflag", "l_linestatus").alias("fl"),
        )
        # dealt by source once: groups and the files of sources are met there, in tasks that don't grow with the table
        raw = raw.where("source_id <> target_id")
        raw = raw.repartition(self._line_tasks, "source_id") if self._line_tasks > 1 else raw
        one = raw.groupBy("source_id", "target_id", "type").agg(F.min("source_line").alias("source_line"), F.min("d").alias("d"), F.min("fl").alias("fl"))
        files = self.nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"))
        method = {"AF": "same_file", "NF": "name_match", "NO": "verified_unique", "RF": "type_flow"}
        resolution = F.lit("import")
        for flag, m in method.items():
            resolution = F.when(F.col("fl") == flag, m).otherwise(resolution)
        confidence = F.when(F.col("d") <= 2, 1.0).when(F.col("d") <= 4, 0.9).when(F.col("d") <= 6, 0.6).when(F.col("d") <= 8, 0.4).otherwise(0.2)
        tier = F.when(F.col("d") <= 4, "CERTIFIED").when(F.col("d") <= 6, "CANDIDATE").otherwise("SPECULATIVE")
        return one.join(files, "source_id").select("source_id", "target_id", "type", "source_line", "source_file", resolution.alias("resolution_method"), confidence.alias("confidence"), tier.alias("trust_tier"), (F.col("d") + 1).cast("int").alias("candidate_count"))

    @cached_property
    def edges(self) -> DataFrame:
        """Edges; for their ids see :attr:`numbered_edges`."""
        return self._plain_edges

    @cached_property
    def numbered_edges(self) -> DataFrame:
        """Edges with ids from 1 in order of source, target and type, numbered by buckets of sources."""
        keyed = self._plain_edges.withColumn("_b", F.floor(F.col("source_id") / ID_BUCKET))
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
        counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        rank = F.row_number().over(Window.partitionBy("_b").orderBy("source_id", "target_id", "type"))
        return keyed.withColumn("_r", rank).join(counts, "_b").select((F.col("_before") + F.col("_r")).alias("id"), *self._plain_edges.columns)

    @cached_property
    def sources(self) -> DataFrame:
        """Source files (file_path, text) that have the graph's nodes as definitions, eight lines each after two of imports."""
        pick = lambda n: (F.col("id") % n).cast("string")
        head = F.concat(F.lit("def "), F.col("name"), F.regexp_extract("signature", r"(\(.*\))", 1), F.lit(":"))
        fourth = F.when(F.col("id") % 2 == 0, 'ValueError("bad")').otherwise('KeyError("bad")')
        fifth = F.when(F.col("is_test"), F.concat(F.lit("    assertEqual(helper_"), pick(5), F.lit("(a), "), pick(10), F.lit(")"))).otherwise(F.concat(F.lit("    self.total = helper_"), pick(5), F.lit("(a)")))
        last = F.when(F.col("id") % 4 == 0, "(a, item)").when(F.col("id") % 4 == 1, "[item]").when(F.col("id") % 4 == 2, "None").otherwise("item")
        function = [head, F.concat(F.lit('    """Doc of '), F.col("name"), F.lit('."""')), F.concat(F.lit("    if check_"), pick(4), F.lit("(a):")), F.concat(F.lit("        raise "), fourth), fifth, F.concat(F.lit("    for item in fetch_"), pick(3), F.lit("(self.size):")), F.concat(F.lit("        return "), last), F.lit("")]
        klass = [F.lit("@dataclass"), F.concat(F.lit("class "), F.col("name"), F.lit(":")), F.lit("    size = 1"), F.lit("    def run(self):"), F.lit("        return self.size"), F.lit(""), F.lit(""), F.lit("")]
        block = F.when(F.col("label") == "Class", F.concat_ws("\n", *klass)).otherwise(F.concat_ws("\n", *function))
        files = self.nodes.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "id", block.alias("block")))).alias("b"))
        return files.select("file_path", F.concat(F.lit("from lib.base import helper_0, helper_1 as h1\n\n"), F.array_join(F.col("b.block"), "\n")).alias("text"))

    @cached_property
    def mixed_sources(self) -> DataFrame:
        """A source file for each node (file_path, text) in one of three languages, with strings and comments that hold code,
        heads and imports over several lines, and each kind of fact about a function; see :data:`TEMPLATES`."""
        template = F.when(F.col("id") % 3 == 0, TEMPLATES["py"]).when(F.col("id") % 3 == 1, TEMPLATES["ts"]).otherwise(TEMPLATES["java"])
        text = F.replace(template, F.lit("NAME"), F.col("name"))
        for mark, n in (("LIMIT", 10), ("KEY", 7), ("HELPER", 5)):
            text = F.replace(text, F.lit(mark), F.concat(F.lit(mark.lower() + "_" if n < 10 else ""), (F.col("id") % n).cast("string")))
        extension = F.when(F.col("id") % 3 == 0, "py").when(F.col("id") % 3 == 1, "ts").otherwise("java")
        tasks = self._tasks("part", FILES_PER_TASK)
        nodes = self._projected_nodes.repartition(tasks, "id") if tasks > 1 else self._projected_nodes
        return nodes.select(F.concat(F.lit("gen/f"), F.col("id").cast("string"), F.lit("."), extension).alias("file_path"), text.alias("text"))

    @cached_property
    def commit_files(self) -> DataFrame:
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("commit_id"), (F.col("l_partkey") + 1).alias("id"))
        orders = self.table("orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"))
        files = lines.join(self.nodes.select("id", "file_path"), "id")
        files = files.repartition(self._line_tasks, "commit_id") if self._line_tasks > 1 else files
        return files.join(orders, "commit_id").select("commit_id", "ts", "file_path").distinct()

    @cached_property
    def properties(self) -> DataFrame:
        kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(("guard_clause", "return_shape", "exception_type", "docstring", "side_effect", "field_read"))])
        rows = self.nodes.where(F.col("label").isin("Function", "Method")).select("id", "start_line", F.explode(kinds).alias("k"))
        rows = rows.where((F.col("id") + F.col("k.i")) % 3 != 0)
        return rows.select(
            (F.col("id") * 8 + F.col("k.i")).cast("long").alias("id"),
            F.col("id").alias("node_id"),
            F.col("k.kind").alias("kind"),
            F.concat("k.kind", F.lit(":"), (F.col("id") % 5).cast("string")).alias("value"),
            (F.col("start_line") + F.col("k.i")).alias("line"),
            F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.8).alias("confidence"),
        )

    @cached_property
    def assertions(self) -> DataFrame:
        tests = self.nodes.where("is_test").select(F.col("id").alias("source_id"))
        names = self.nodes.select(F.col("id").alias("target_id"), F.col("name").alias("_name"))
        e = self.numbered_edges.where("type = 'CALLS'").join(tests, "source_id").join(names, "target_id")
        kind = F.when(F.col("id") % 3 == 0, "assertEqual").when(F.col("id") % 3 == 1, "assertRaises").otherwise("assert")
        return e.select(
            "id",
            F.col("source_id").alias("test_node_id"),
            F.when(F.col("confidence") >= 0.9, F.col("target_id")).otherwise(0).alias("target_node_id"),
            kind.alias("kind"),
            F.concat(F.lit("check("), "_name", F.lit("(x))")).alias("expression"),
            F.col("source_line").cast("string").alias("expected"),
            F.col("source_line").alias("line"),
        )

    @cached_property
    def interventions(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            "ts",
            F.concat(F.lit("tool_"), kind).alias("tool"),
            F.col("user_id").alias("run_id"),
            F.when(kind.isin("click", "view"), "brief").otherwise("validate").alias("phase"),
            F.when(kind == "error", "errors_found").when(kind == "purchase", "fixed_ai").otherwise("valid").alias("outcome"),
            F.round("value").cast("int").alias("latency_ms"),
            (kind == "purchase").alias("ai_called"),
            "props",
        )


def from_tables(spark: SparkSession, path: str) -> Graph:
    """The graph that the relational tables under ``path`` stand for."""
    return Graph(spark, path)


def from_parquet(spark: SparkSession, path: str) -> Graph:
    """A stored graph: nodes, edges, properties, assertions, commit_files and interventions under ``path``."""
    graph = Graph(spark, path)
    for name in ("nodes", "edges", "properties", "assertions", "commit_files", "interventions"):
        graph.__dict__[name] = graph.table(name)
    graph.__dict__["_plain_edges"] = graph.__dict__["edges"].drop("id")
    return graph
