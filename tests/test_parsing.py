"""The source parser on small files of several languages."""

import pytest
from pyspark.sql import functions as F

from symloom.operators import parsing as ps

PYTHON = '''import os
from .base import Token as T, parse_expr


@register
@dataclass
class Reader(Base):
    limit: int = 3

    def read(self, path: str, n=1) -> dict[str, int]:
        """Reads it."""
        if not path:
            raise ValueError("no path")
        with open(path) as f:
            a, b = parse_expr(f)
        for x in self.rows():
            if x.size > 10:
                return None
        token = os.environ["API_TOKEN"]
        self.count = a
        return (a, self.limit)


def test_read():
    try:
        got = Reader().read("x")
    except (OSError, ValueError) as e:
        pass
    assert got == (1, 3)
    r.open()
    r.close()
'''
FILES = [
    ("src/reader.py", PYTHON),
    ("web/app.ts", "import { a, b as c } from './lib';\nexport class App extends Base {\n  run(x: number): string {\n    return this.name;\n  }\n}\nexport function go(a, b) {\n  fetch(a);\n}\n"),
    ("cmd/main.go", 'package main\n\nimport (\n\t"fmt"\n\t"x/y"\n)\n\ntype Server struct {\n\tname string\n}\n\nfunc (s *Server) Start(port int) error {\n\tif port == 0 {\n\t\treturn nil\n\t}\n\tfmt.Println(port)\n\treturn nil\n}\n'),
    ("A.java", "import a.b.C;\npublic class A {\n    public int size(String s, int n) {\n        throw new IllegalStateException(s);\n    }\n}\n"),
    ("lib.rs", "use a::b::{C, D};\npub fn run(x: i32) -> i32 {\n    x\n}\n"),
    ("gen.py", "# Code generated by tool. DO NOT EDIT.\ndef f():\n    pass\n"),
    ("node_modules/x.js", "function f() {\n}\n"),
    ("notes.md", "# text"),
    ("empty.py", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame(FILES, "file_path string, text string")
    rows = ps.statements(ps.sources(files)).cache()
    nodes = ps.definitions(rows).cache()
    return rows, nodes, ps.bodies(rows, nodes).cache()


def test_definitions(parsed):
    got = {(r["file_path"], r["label"], r["qualified_name"], r["start_line"], r["end_line"], r["return_type"]) for r in parsed[1].collect()}
    assert got == {
        ("src/reader.py", "Class", "Reader", 7, 21, ""),
        ("src/reader.py", "Method", "Reader.read", 10, 21, "dict[str, int]"),
        ("src/reader.py", "Function", "test_read", 24, 31, ""),
        ("web/app.ts", "Class", "App", 2, 6, ""),
        ("web/app.ts", "Method", "App.run", 3, 5, "string"),
        ("web/app.ts", "Function", "go", 7, 9, ""),
        ("cmd/main.go", "Class", "Server", 8, 10, ""),
        ("cmd/main.go", "Function", "Start", 12, 18, "error"),
        ("A.java", "Class", "A", 2, 6, ""),
        ("A.java", "Method", "A.size", 3, 5, ""),
        ("lib.rs", "Function", "run", 2, 4, "i32"),
    }


def test_imports(parsed):
    got = {(r["file_path"], r["module_path"], r["imported_name"]) for r in ps.imports(parsed[0]).collect()}
    assert got == {("src/reader.py", "os", "*"), ("src/reader.py", ".base", "Token"), ("src/reader.py", ".base", "parse_expr"), ("web/app.ts", "./lib", "a"), ("web/app.ts", "./lib", "b"), ("cmd/main.go", "fmt", "*"), ("cmd/main.go", "x/y", "*"), ("A.java", "a.b", "C"), ("lib.rs", "a::b", "C"), ("lib.rs", "a::b", "D")}


@pytest.mark.parametrize("path, line, module, name", [("a.cs", "using System.IO;", "System.IO", "*"), ("a.php", "use A\\B\\C;", "A\\B", "C"), ("a.cpp", "#include <vector>", "vector", "*"), ("a.swift", "import UIKit", "UIKit", "*"), ("a.ml", "open List", "List", "*"), ("a.rb", "require 'json'", "json", "*"), ("a.ex", "alias A.B", "A.B", "*"), ("a.lua", "local x = require('m')", "m", "*"), ("a.scala", "import a.b.{C, D}", "a.b", "C"), ("a.kt", "import a.b.C", "a.b", "C"), ("a.js", "const x = require('y')", "y", "*")])
def test_imports_of_other_languages(spark, path, line, module, name):
    rows = ps.imports(ps.statements(ps.sources(spark.createDataFrame([(path, line)], "file_path string, text string")))).collect()
    assert (module, name) in {(r["module_path"], r["imported_name"]) for r in rows}


def test_calls_and_contexts(parsed):
    got = {(r["callee_name"], r["context"]) for r in ps.calls(parsed[2]).where("file_path = 'src/reader.py'").collect()}
    assert {("parse_expr", "destructure_tuple"), ("rows", "iterated"), ("open", None), ("Reader", "exception_guard"), ("read", "exception_guard"), ("ValueError", None)} <= got


def test_properties(parsed):
    rows, nodes, body = parsed
    named = ps.properties(body, nodes, rows).join(nodes.select(F.col("id").alias("node_id"), "name"), "node_id")
    got = {(r["name"], r["kind"], r["value"]) for r in named.collect()}
    assert {
        ("read", "docstring", "Reads it."), ("read", "guard_clause", "not path"), ("read", "exception_type", "ValueError"), ("read", "exception_flow", "WHEN not path: raise ValueError(\"no path\")"),
        ("read", "return_shape", "none"), ("read", "return_shape", "tuple|(a, self.limit)"), ("read", "conditional_return", "if x.size > 10: return None"), ("read", "side_effect", "count"),
        ("read", "param", "path:str [required]"), ("read", "param", "n opt=1"), ("test_read", "exception_handler", "except (OSError, ValueError) as e -> handles"), ("read", "field_read", "limit"),
        ("Reader", "class_field", "limit"), ("Reader", "class_decorator", "register"), ("Reader", "class_decorator", "dataclass"),
        ("read", "config_read", "env: API_TOKEN"), ("read", "resource_pattern", "context_manager: open(path) as f"), ("test_read", "call_order", "r: open -> close"), ("read", "visibility", "public"), ("read", "caller_usage", "rows:iterated"), ("size", "exception_type", "IllegalStateException"),
    } <= got
    assert {v for n, k, v in got if n == "read" and k == "fingerprint"} == {"3|ValueError,open,parse_expr,rows"}


def test_assertions(parsed):
    assert [tuple(r) for r in ps.assertions(parsed[2]).select("kind", "expression", "expected").collect()] == [("assert", "got", "(1, 3)")]


def test_manifests(spark):
    files = [("requirements.txt", "# x\nnumpy==1.2\nflask>=2 ; x\n"), ("w/package.json", '{"dependencies": {"react": "^18"}, "devDependencies": {"jest": "1"}}'), ("go.mod", "module m\nrequire github.com/a/b v1.0.0\n"), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2" }\n[dev-dependencies]\ncrit = "0.3"\n'), ("x.txt", "numpy==9"), ("package.json", None)]
    got = {tuple(r) for r in ps.manifests(spark.createDataFrame(files, "file_path string, text string")).select("name", "version", "package_manager", "is_dev").collect()}
    assert got == {("numpy", "1.2", "pip", False), ("flask", "2", "pip", False), ("react", "^18", "npm", False), ("jest", "1", "npm", True), ("github.com/a/b", "v1.0.0", "go", False), ("serde", "1.0", "cargo", False), ("tokio", "1.2", "cargo", False), ("crit", "0.3", "cargo", True)}


def test_scan_of_a_folder(spark, tmp_path):
    for path, text in FILES:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text or "")
    got = {r["file_path"] for r in ps.scan(spark, str(tmp_path), ["*.rs", "# no", "/cmd/"]).collect()}
    assert got == {"src/reader.py", "web/app.ts", "A.java"}  # readers leave empty files out


def test_files_over_the_scan_limit_are_parsed(spark):
    text = "import os\n" + "def f():\n    pass\n" * (ps.MOST_BYTES // 18 + 10)
    files = ps.sources(spark.createDataFrame([("src/large.py", text)], "file_path string, text string"))
    assert files.count() == 1 and ps.imports(ps.statements(files)).count() == 1
