"""Logical lines come from one scan of each file, without shuffles, and equal those that windows over brackets give."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.operators import lexing
from symloom.sources.graph import from_tables

BITS = ["(", ")", "[", "]", "{", "}", "{\n", "\n", "\n", "a", " ", "'", "\\", "import ", "fn x", "//"]
EXTENSIONS = {"py": "python", "ts": "typescript", "rs": "rust", "java": "java"}


def random_files(spark, n=200):
    r = random.Random(3)
    rows = [(f"{i}.{e}", EXTENSIONS[e], "".join(r.choice(BITS) for _ in range(r.randint(0, 50)))) for i in range(n) for e in [r.choice(list(EXTENSIONS))]]
    return spark.createDataFrame(rows, "file_path string, language string, text string")


def test_one_scan_and_no_shuffle(spark):
    plan = lexing.logical_lines(random_files(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan
    assert plan.count("regexp_extract_all") <= 3


def test_depths_and_blocks_equal_windows(spark):
    files = random_files(spark)
    marks = lexing.brackets(lexing.physical_lines(files))
    depth = marks.where("kind = 'e'").select("file_path", F.col("line") + 1, F.col("level")).toDF("file_path", "line", "before")
    lines = lexing.logical_lines(files)
    off = lines.join(depth, ["file_path", "line"], "left").where("depth <> coalesce(before, 0)")
    assert lines.count() > 200 and off.count() == 0
    # the last block that opens in a line at the line's depth
    inside = marks.join(lines.select("file_path", F.col("line").alias("first"), "last_line", "depth", "block_end", F.trim("code").alias("c")), "file_path").where("line BETWEEN first AND last_line AND kind = '{' AND level = depth + 1 AND c <> ''")
    last = inside.withColumn("n", F.row_number().over(Window.partitionBy("file_path", "first").orderBy(F.desc("line"), F.desc("at")))).where("n = 1")
    size = lines.groupBy("file_path").agg(F.max("last_line").alias("size"))
    assert last.count() > 50
    assert last.join(size, "file_path").where("block_end IS DISTINCT FROM coalesce(partner, size)").count() == 0


def test_folded_by_hand():
    first, last, before, end, behind = map(list, lexing.folded("{e(ee)e)e"))
    assert (first, last, before, end, behind) == ([1, 2, 5], [1, 4, 5], [0, 1, 1], [5, 0, 0], [0, 0, 0])
    assert [list(x) for x in lexing.folded("(g")] == [[1], [1], [0], [0], [0]]


def test_mixed_sources_are_dealt(spark):
    # one task read all of sf0.1's 20,000 files
    assert from_tables(spark, "/root/testdata/sf0.1").mixed_sources.rdd.getNumPartitions() == 8
