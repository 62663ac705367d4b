"""Whitening of embeddings by shifted Cholesky QR.

A pass over the centred rows sums their Gram matrix. Its Cholesky factor, with a small shift that keeps it positive, makes
the rows orthogonal by a triangular solve but for rounding and the shift; passes follow until they are. The factors'
product is the R of the rows' QR decomposition, and the singular value decomposition of R gives the components. Rows never
leave their tasks: a pass gives a matrix a task, summed by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components returned, what an entry is multiplied by, and what is added to its floor.
COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Passes that make rows orthogonal at most, and when they are: the largest deviation of an eigenvalue from 0 and 1.
PASSES, ORTHOGONAL = 6, 1e-10
#: Rows of a block, whose products are summed at once; eigenvalues below this share of the largest count as none.
BLOCK, NOTHING = 4096, 1e-14
#: Entries of one size at most, so that scaling and rounding are exact and longs hold them.
LARGEST = float(1 << 46)


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n for rows of longs: whole parts apart, so that nothing is lost where x is large and spreads little."""
    whole, rest = sums // n, sums % n
    return (x - whole).astype(np.float64) - rest.astype(np.float64) / n


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix, by forward substitution."""
    out = rows.copy()
    for j in range(upper.shape[0]):
        out[:, j] -= out[:, :j] @ upper[:j, j]
        out[:, j] /= upper[j, j]
    return out


def gram(fitted: DataFrame, dimension: int, of: Callable[[np.ndarray], np.ndarray], width: int | None = None) -> np.ndarray:
    """The Gram matrix of ``of(x)`` over all rows: blocks summed in tasks, tasks' entries summed by Spark."""
    width = width or dimension
    upper = np.triu_indices(width)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _rows(batch, "x")
            for at in range(0, len(x), BLOCK):
                rows = of(x[at : at + BLOCK])
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], ["i", "j", "v"])

    entries = fitted.select("x").mapInArrow(summed, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # width squared rows at most
    out = np.zeros((width, width))
    i, j, v = (entries.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v
    return out


def shifted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """The upper factor of a Gram matrix, shifted by the bound of its rounding errors; by more while that isn't enough."""
    d = len(matrix)
    shift = 11 * (d * BLOCK + d * (d + 1)) * np.finfo(float).eps / 2 * max(float(np.trace(matrix)), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def orthogonalised(fitted: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, G): the centred rows are Q R with G the Gram matrix of Q, the identity but for directions without any spread."""
    factors: list[np.ndarray] = []
    total = np.eye(len(sums))
    while True:
        now = list(factors)

        def applied(x: np.ndarray) -> np.ndarray:
            rows = centred(x, n, sums)
            for upper in now:
                rows = solved(rows, upper)
            return rows

        found = gram(fitted, len(sums), applied)
        values = np.linalg.eigvalsh(found)
        if factors and bool(np.all((np.abs(values - 1) <= ORTHOGONAL) | (np.abs(values) <= 1e-3))) or len(factors) == PASSES:
            return total, found
        factors.append(shifted_cholesky(found))
        total = factors[-1] @ total


def components(upper: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of the rows' Gram matrix, falling, without those that are nothing."""
    values, vectors = np.linalg.eigh(rest)
    _, sizes, right = np.linalg.svd(np.sqrt(np.where(values > 0.5, values, 0))[:, None] * (vectors.T @ upper))
    keep = sizes**2 > NOTHING * max(float((sizes**2).max(initial=0)), np.finfo(float).tiny)
    right = right[keep]
    signs = np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)]) if len(right) else np.ones(0)
    return sizes[keep] ** 2, (right * signs[:, None]).T


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x of the rows whose vector has numbers only, written; vectors of the commonest length alone."""
    vector = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(sound)
    rows = written(rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(OFFSET).cast("long")).alias("x")), "whiten-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries are whole numbers, floor(64 c) + 1,000,000. Components fall by eigenvalue; the sign makes the largest entry of
    a component positive. Rows without a vector, or with a null or non-finite entry, are dropped; so are entries of 2^46 and
    more, which no long could hold, and vectors that haven't the commonest length (ties: the longer one). Components without
    spread can't be whitened and give no rows, so fewer vectors than dimensions give fewer components, and one vector, equal
    ones or an empty table no rows. Repeated rows and null ids are vectors of their own. A deviation beyond a long is null.
    Other columns of ``df`` are not read, whatever their names.
    """
    fitted = usable(df, id_col, vector_col)
    found = fitted.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count("x").alias("n")).orderBy("i").collect()  # a row a dimension
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    n, sums = found[0]["n"], np.array([r["s"] for r in found], np.int64)
    upper, rest = orthogonalised(fitted, n, sums)
    values, vectors = components(upper, rest)
    share = values[:count] / values.sum() if len(values) else values
    projection = vectors[:, :count] / np.sqrt(values[:count] / n)
    width = len(share)
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    error = float(np.abs(gram(fitted, len(sums), lambda x: centred(x, n, sums) @ projection, width) / n - np.eye(width)).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, "x")
            far = deviations(x, n, sums)
            white = (centred(x, n, sums) @ projection).reshape(-1)
            lists = pa.ListArray.from_arrays(np.arange(0, len(white) + 1, width, dtype=np.int32), pa.array(white))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.int64()), lists], ["vec_id", "deviation", "white"])

    rows = fitted.select("vec_id", "x").mapInArrow(projected, "vec_id long, deviation long, white array<double>")
    rows = rows.select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened"))
    shares = F.array(*[F.lit(float(s)) for s in share])
    return rows.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Of each row the sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
    most = max((abs(n * int(v) - int(s)) for v, s in zip((*x.min(axis=0), *x.max(axis=0)), (*sums, *sums))), default=0) if len(x) else 0
    if most * most * max(1, x.shape[1] if x.ndim > 1 else 1) < 1 << 63 and n * int(np.abs(x).max(initial=0)) < 1 << 63:
        far = n * x - sums
        return (far * far).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]
