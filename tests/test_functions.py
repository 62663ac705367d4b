import pytest
from pyspark.sql import functions as F

from symloom.functions import scalars as s


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, parts",
    [("ASTBuilder", ["ast", "builder"]), ("my-token-type", ["my", "token", "type"]), ("parse_expr", ["parse", "expr"]), ("HTTPServer2x", ["http", "server2x"]), ("", [])],
)
def test_name_parts(spark, name, parts):
    assert one(spark, s.name_parts(F.lit(name))) == parts


@pytest.mark.parametrize("path, test", [("tests/test_p.py", True), ("src/a_test.go", True), ("src/ast.py", False), ("src/latest/x.py", False), ("web/a.spec.ts", True)])
def test_test_paths(spark, path, test):
    assert one(spark, s.is_test_path(F.lit(path))) is test


@pytest.mark.parametrize("a, b, like", [("", "", 1.0), ("abc", "", 0.0), ("abcd", "abce", 0.75)])
def test_levenshtein_similarity(spark, a, b, like):
    assert one(spark, s.levenshtein_similarity(F.lit(a), F.lit(b))) == like


@pytest.mark.parametrize(
    "url, path",
    [("https://h.com/api/users/12?x=1", "/api/users"), ("/api/{id}/x", "/api/x"), ("/a/:id/b#f", "/a/b"), ("http://h", "/"), ("/x/<int>/123e4567-e89b-12d3-a456-426614174000", "/x")],
)
def test_api_path(spark, url, path):
    assert one(spark, s.api_path(F.lit(url))) == path


def test_wilson_without_trials(spark):
    low, high = s.wilson(F.lit(0.0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)


def test_path_and_text_helpers(spark):
    assert one(spark, s.normalized_path(F.lit(".\\a\\b.py"))) == "a/b.py"
    assert one(spark, s.stem(F.lit("a/b.test.py"))) == "b.test"
    assert one(spark, s.directory(F.lit("b.py"))) == ""
    assert one(spark, s.camel_to_snake(F.lit("HTTPServerName"))) == "http_server_name"
    assert one(spark, s.truncated(F.lit("a" * 101))) == "a" * 100 + "..."
    assert one(spark, s.parameter_count(F.lit("f(a, b)"))) == 2
    assert one(spark, s.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
