"""Sources whose strings, comments, long heads and nesting mislead patterns over plain lines."""

import random

import pytest

from symloom.operators import lexing
from symloom.operators import parsing as ps

HARD_PYTHON = '''import os, sys as system, json
from a.b import (
    first,  # the first
    second as other,
)
from c import d; x = 1

TEXT = """
class Fake: no
def ghost(): pass
import nothing
"""
NAME = 'def string_def(): call_in_string()'  # def comment_def():


def one(): return two(3)


async def long_head(
    a: dict[str, int] = {},
    b=make_default("x, (y)", 1),
    *,
    c: str = "):",
) -> list[str]:
    """First line.

    def ghost_in_docstring(): pass
    """
    value = compute(
        a,
        "unclosed ( in a string",
    )
    if value == 3 and \\
            check(value):
        return "text # no comment"

    def inner(x):
        return helper(x)
    return inner


class Outer:
    limit = 3

    class Nested:
        def deep(self):
            # def commented(): pass
            return 1

    def last(self):
        def local():
            return 2
        return local
'''
HARD_JS = """import {
  alpha,
  beta as b,
} from './lib';
import def from "mod";
const quoted = "function fake() {";
const re = /["'{]/g;
/* function blocked() {
 */
const add = (a, b) => {
  return sum(a, b);
};
export const short = async x => send(x);
let old = function (p, q = { r: 1 }) { return run(p); };
export function many(
  a,
  b = {},
) {
  list.forEach(function (item) {
    use(item);
  });
  return `template ${a} { `;
}
class Box {
  get size() {
    return this.n;
  }
  handle = (event) => {
    this.fire(event);
  };
  static async build(x) { return new Box(x); }
}
"""
HARD_C = """#include <stdio.h>
#include "own.h"
static int add(int a, int b)
{
    /* int fake(int x) { */
    return sum(a, b);
}

struct point *make_point(const char *name,
                         int x) {
    if (x > 0) {
        printf("} not a brace {");
    }
    char c = '{';
    return find(name);
}
int declared(int x);
int table[] = { 1, 2 };
"""
HARD_JAVA = """package a.b;
import a.b.C;
import static d.E.run;
class Store<T extends Comparable<T>> {
    private final Map<String, List<T>> rows = new HashMap<>();
    int size() { return rows.size(); }
    <R> List<R> map(Function<T, R> f,
                    int most) throws IOException {
        // void commented() {
        return apply(f, "void quoted() {");
    }
    @Override
    public String toString() {
        Runnable r = () -> { work(); };
        return text;
    }
    interface Visitor { void visit(Store s); }
}
"""
HARD_GO = 'package m\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\nimport "os"\n\nvar raw = `func fake() {`\n\nfunc Map[T any](xs []T,\n\tf func(T) T) []T {\n\tout := make([]T, 0)\n\tfor _, x := range xs {\n\t\tout = append(out, f(x))\n\t}\n\treturn out\n}\n'
HARD_RUST = "use a::{\n    b,\n    c as d,\n};\npub fn run<'a, T: Fn(i32) -> i32>(x: &'a str, f: T) -> Result<i32, E>\nwhere\n    T: Copy,\n{\n    let c = 'x';\n    f(1)\n}\n"
HARD_RUBY = "require 'json'\nclass Tool\n  def run(x)\n    text = \"def fake\"\n    go(x)\n  end\n\n  def done?\n    true\n  end\nend\n"
FILES = [("h.py", HARD_PYTHON), ("h.js", HARD_JS), ("h.c", HARD_C), ("H.java", HARD_JAVA), ("h.go", HARD_GO), ("h.rs", HARD_RUST), ("h.rb", HARD_RUBY), ("none.py", ""), ("null.py", None), ("open.js", "function f( {\n 'unclosed\n"), ("open.py", 'def f():\n    """never closed\n    def g():\n')]


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame(FILES, "file_path string, text string")
    rows = ps.statements(ps.sources(files)).cache()
    nodes = ps.definitions(rows).cache()
    return rows, nodes, ps.bodies(rows, nodes).cache()


def of(parsed, path):
    return {(r["label"], r["qualified_name"], r["start_line"], r["end_line"]) for r in parsed[1].where(f"file_path = '{path}'").collect()}


def test_python(parsed):
    assert of(parsed, "h.py") == {
        ("Function", "one", 16, 16), ("Function", "long_head", 19, 39), ("Function", "inner", 37, 38), ("Class", "Outer", 42, 53), ("Class", "Nested", 45, 48),
        ("Method", "Nested.deep", 46, 48), ("Method", "Outer.last", 50, 53), ("Function", "local", 51, 52),
    }


def test_script(parsed):
    assert of(parsed, "h.js") == {
        ("Function", "add", 10, 12), ("Function", "short", 13, 13), ("Function", "old", 14, 14), ("Function", "many", 15, 23), ("Class", "Box", 24, 32),
        ("Method", "Box.size", 25, 27), ("Method", "Box.handle", 28, 30), ("Method", "Box.build", 31, 31),
    }


def test_c_and_java(parsed):
    assert of(parsed, "h.c") == {("Function", "add", 3, 7), ("Function", "make_point", 9, 16)}
    assert of(parsed, "H.java") == {("Class", "Store", 4, 18), ("Method", "Store.size", 6, 6), ("Method", "Store.map", 7, 11), ("Method", "Store.toString", 13, 16), ("Class", "Visitor", 17, 17)}


def test_go_rust_ruby(parsed):
    assert of(parsed, "h.go") == {("Function", "Map", 11, 18)}
    assert of(parsed, "h.rs") == {("Function", "run", 5, 11)}
    assert of(parsed, "h.rb") == {("Class", "Tool", 2, 11), ("Method", "Tool.run", 3, 6), ("Method", "Tool.done?", 8, 10)}


def test_unclosed_and_empty(parsed):
    assert of(parsed, "none.py") == of(parsed, "null.py") == set()
    assert {(name, start) for _, name, start, _ in of(parsed, "open.py")} == {("f", 1)}


def test_parameters_keep_their_strings(parsed):
    got = {(r["name"], r["parameters"], r["return_type"]) for r in parsed[1].where("name IN ('long_head', 'map', 'run', 'old', 'short')").select("name", "parameters", "return_type").collect()}
    assert ("long_head", 'a: dict[str, int] = {}, b=make_default("x, (y)", 1), *, c: str = "):"', "list[str]") in got
    assert ("old", "p, q = { r: 1 }", "") in got and ("short", "x", "") in got
    assert ("map", "Function<T, R> f, int most", "") in got


def test_imports(parsed):
    got = {(r["file_path"], r["module_path"], r["imported_name"]) for r in ps.imports(parsed[0]).collect()}
    assert got == {
        ("h.py", "os", "*"), ("h.py", "sys", "*"), ("h.py", "json", "*"), ("h.py", "a.b", "first"), ("h.py", "a.b", "second"), ("h.py", "c", "d"),
        ("h.js", "./lib", "alpha"), ("h.js", "./lib", "beta"), ("h.js", "mod", "def"), ("h.c", "stdio.h", "*"), ("h.c", "own.h", "*"), ("H.java", "a.b", "C"), ("H.java", "d.E", "run"),
        ("h.go", "fmt", "*"), ("h.go", "a/b", "*"), ("h.go", "os", "*"), ("h.rs", "a", "b"), ("h.rs", "a", "c"), ("h.rb", "json", "*"),
    }


def test_calls(parsed):
    rows = ps.calls(parsed[2]).join(parsed[1].selectExpr("id AS caller_id", "name"), "caller_id").collect()
    got = {(r["name"], r["callee_name"]) for r in rows}
    assert {("one", "two"), ("long_head", "make_default"), ("long_head", "compute"), ("long_head", "check"), ("inner", "helper"), ("add", "sum"), ("short", "send"), ("old", "run"), ("many", "forEach"), ("many", "use"), ("handle", "fire"), ("build", "Box"), ("make_point", "printf"), ("make_point", "find"), ("size", "size"), ("map", "apply"), ("toString", "work"), ("Map", "append"), ("Map", "f"), ("run", "f"), ("run", "go")} <= got
    assert not {c for _, c in got} & {"call_in_string", "ghost", "ghost_in_docstring", "fake", "commented", "quoted", "blocked", "string_def"}
    assert next(r["line"] for r in rows if r["callee_name"] == "compute") == 29


def test_docstring_is_one_line(parsed):
    got = {(r["kind"], r["value"]) for r in ps.properties(parsed[2], parsed[1], parsed[0]).where("kind IN ('docstring', 'return_shape', 'conditional_return')").collect()}
    assert ("docstring", "First line.") in got and ("return_shape", 'value|"text # no comment"') in got
    assert ("conditional_return", 'if value == 3 and check(value): return "text # no comment"') in got


def scan(text):
    """Python's strings and comments blanked, character by character."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] == "#":
            while i < n and text[i] != "\n":
                out.append(" ")
                i += 1
        elif text[i] in "\"'":
            q, start = text[i], i
            if text[i : i + 3] == q * 3:
                end = text.find(q * 3, i + 3)
                i = n if end < 0 else end + 3
            else:
                i += 1
                while i < n and text[i] not in (q, "\n") and text[i:] != "\\":
                    i += 2 if text[i] == "\\" else 1
                i += i < n and text[i] == q
            token = text[start:i]
            inner = "".join(c if c == "\n" else "_" for c in token[1:-1])
            out.append(token[0] + inner + (token[-1] if len(token) > 1 else ""))
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_scanner_equals_a_plain_one(spark):
    r = random.Random(5)
    bits = ['"', "'", '"""', "'''", "#", "\\", "\n", "a", " ", "(", "]", "\\\"", "{"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(300)]
    files = spark.createDataFrame([(f"{i}.py", "python", t) for i, t in enumerate(texts)], "file_path string, language string, text string")
    got = {r["file_path"]: r["code"].replace(lexing.OPEN, "") for r in lexing.scanned(files).collect()}
    assert got == {f"{i}.py": scan(t) for i, t in enumerate(texts)}


def partners(text):
    """Lines of the partners of opening brackets, by a stack."""
    stack, found, line = [], {}, 1
    for i, c in enumerate(text):
        if c in "([{":
            stack.append((line, i))
        elif c in ")]}" and stack:
            found[stack.pop()] = line
        line += c == "\n"
    return sorted((start, end) for (start, _), end in found.items())


def test_partners_equal_a_stack(spark):
    r = random.Random(7)

    def nested(depth):
        return "".join(r.choice(["x", "\n", " "]) if r.random() < 0.6 or depth > 6 else (lambda o: o + nested(depth + 1) + {"(": ")", "[": "]", "{": "}"}[o])(r.choice("([{")) for _ in range(r.randint(0, 8)))

    texts = [nested(0) for _ in range(100)]
    files = spark.createDataFrame([(f"{i}.go", "go", t) for i, t in enumerate(texts)], "file_path string, language string, text string")
    got = {}
    for row in lexing.brackets(lexing.physical_lines(files)).where("kind IN ('(', '{', 'l')").collect():
        got.setdefault(row["file_path"], []).append((row["line"], row["partner"]))
    assert {k: sorted(v) for k, v in got.items()} == {f"{i}.go": partners(t) for i, t in enumerate(texts) if partners(t)}


def test_a_long_file_is_parsed(spark):
    text = "".join(f"def f{i}(a,\n       b=')'):\n    return g{i}(a)\n" for i in range(4000))
    rows = ps.statements(ps.sources(spark.createDataFrame([("long.py", text)], "file_path string, text string")))
    nodes = ps.definitions(rows)
    assert nodes.where("end_line - start_line = 2").count() == 4000
