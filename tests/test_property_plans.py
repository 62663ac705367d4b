"""Facts of classes meet lines by line, and words of security and locks are found as whole words."""

import re

from symloom.operators import parsing as ps

TEXT = """class A:
    size = 1

    def login(self):
        inner = Lock()
        return inner

    kind: int = 2
"""


def parsed(spark):
    files = spark.createDataFrame([("a.py", TEXT), ("b.py", TEXT.replace("login", "blogin"))], "file_path string, text string")
    return ps.parsed(ps.sources(files))


def test_classes_meet_lines_by_line(spark):
    rows, nodes, _ = parsed(spark)
    plan = ps._of_classes(rows, nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not re.search(r"Join \[file_path#\d+L?\]", plan)


def test_fields_words_and_locks(spark):
    rows, nodes, body = parsed(spark)
    kinds = ("class_field", "security_tag", "concurrency_pattern")
    found = ps.properties(body, nodes, rows).join(nodes.select("id", "file_path"), ps.F.col("node_id") == ps.F.col("id"))
    got = {(r["file_path"], r["kind"], r["value"], r["line"]) for r in found.collect() if r["kind"] in kinds}
    fields = {(f, "class_field", v, n) for f in ("a.py", "b.py") for v, n in (("size", 2), ("kind", 8))}
    locks = {(f, "concurrency_pattern", "lock: inner = Lock()", 5) for f in ("a.py", "b.py")}
    assert got == fields | locks | {("a.py", "security_tag", "authentication: login", 4)}
