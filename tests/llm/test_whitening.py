"""Whitening against numpy's eigenvectors and exact whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import queries, whitening


def plain(vectors, count=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    far = [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    y = np.array([[(n * c - t) / n for c, t in zip(row, s)] for row in x])
    values, vecs = np.linalg.eigh(y.T @ y / n)
    return n, far, y, values[::-1][:count], vecs[:, ::-1][:, :count], values.sum()


def check(rows, vectors, count=32):
    n, far, y, values, vecs, trace = plain(vectors, count)
    width = rows.component.max()
    assert len(rows) == n * width and (rows.n == n).all() and rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-8
    rows = rows.sort_values(["vec_id", "component"])
    assert rows.deviation.to_numpy().reshape(n, width)[:, 0].tolist() == far
    white = rows.whitened.to_numpy().reshape(n, width)
    theirs = y @ vecs[:, :width] / np.sqrt(values[:width])
    for k in range(width):
        alone = all(abs(values[k] - v) > 1e-3 * values[k] for i, v in enumerate(values) if i != k)
        if alone:
            assert min(np.abs(white[:, k] - theirs[:, k]).max(), np.abs(white[:, k] + theirs[:, k]).max()) < 1e-7
    assert np.abs(white.T @ white / n - np.eye(width)).max() < 1e-8
    assert np.allclose(rows.explained.to_numpy()[:width], values[:width] / trace, rtol=1e-8)
    return width


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").toPandas()
    rows = queries.QUERIES["op12_whitening"](spark, sf_dir)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert check(rows.toPandas(), df.embedding.tolist()) == 32


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, x string, component int")


@pytest.mark.parametrize("kind", ["steep", "dependent", "few", "far", "repeated"])
def test_hard_tables(spark, kind):
    r = np.random.default_rng(3)
    a = r.standard_normal((200, 6)) * [1000, 100, 10, 5, 3, 2]
    rank = 6
    if kind == "dependent":
        a = np.round(a)
        a[:, 5] = a[:, 0] - 2 * a[:, 1]
        a[:, 4] = 7.0
        rank = 4
    if kind == "few":
        a, rank = a[:4], 3
    if kind == "far":
        a = a + [1e9, -1e9, 0, 5e8, 1, 2]
    if kind == "repeated":
        a = np.concatenate([np.repeat(a[:1], 400, axis=0), a])
    assert check(whitening.whiten(frame(spark, a.tolist())).toPandas(), a.tolist()) == rank


def test_odd_rows(spark):
    good = [[float(i % 7), float(i * i % 11), float(i)] for i in range(20)]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1.0, 2.0], [1e300, 1.0, 1.0]]
    rows = whitening.whiten(frame(spark, good + odd)).toPandas()
    assert set(rows.vec_id) == set(range(20)) and check(rows, good) == 3


def test_nothing_to_whiten(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]):
        out = whitening.whiten(frame(spark, vectors))
        assert out.count() == 0 and len(out.columns) == 7


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 3], [5, 3]])
    assert whitening.deviations(x, 1000, np.array([7, 8])) == [None, (5000 - 7) ** 2 + (3000 - 8) ** 2]


def test_substitution():
    r = np.random.default_rng(0)
    upper = np.triu(r.standard_normal((5, 5))) + 3 * np.eye(5)
    rows = r.standard_normal((9, 5))
    assert np.allclose(whitening.solved(rows, upper) @ upper, rows)


def test_types(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 40")
    once = whitening.whiten(df.withColumn("embedding", F.col("embedding").cast("array<double>"))).toPandas()
    assert whitening.whiten(df).toPandas()[["vec_id", "component", "deviation"]].sort_values(["vec_id", "component"]).reset_index(drop=True).equals(once[["vec_id", "component", "deviation"]].sort_values(["vec_id", "component"]).reset_index(drop=True))
