"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors of length 1 are projected by a Gaussian matrix to a few dimensions. The squared projected distance of two
vectors, divided by their squared distance, has a chi-square distribution, so points whose projected distance is large
for the nearest found so far are unlikely to be nearer. The upper levels of the kd-tree, fitted to a bounded sample, cut
the projected space into cells that are dealt to tasks; the lower levels are built in each task. A query searches its own
cell, then those others that the test doesn't rule out; in a cell, leaves are verified in order of projected distance
until the test holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Projected dimensions, and the probability at which the test stops a search.
DIMENSIONS, CONFIDENCE = 8, 0.9
#: Distinct vectors that the upper levels are fitted to at most, vectors in a cell about (least, most), vectors in a leaf.
SAMPLE, CELL, MOST_CELL, LEAF = 20_000, 2048, 65_536, 64
#: Squared distances so near count as equal.
TIE = 1e-12
#: Cells of the upper levels at most; larger tables deal a cell's vectors to more tasks by hash.
CELLS = 1024
SEED = 7


def chi_square_point(share: float, freedom: int) -> float:
    """Quantile of the chi-square distribution, by the cube-root approximation of Wilson and Hilferty."""
    a = 2 / (9 * freedom)
    return freedom * (1 - a + NormalDist().inv_cdf(share) * a**0.5) ** 3


def projection(dimension: int, to: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension, to))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Splits:
    """The upper levels: planes across the widest dimension at the median, and the box of every cell."""

    def __init__(self, points: np.ndarray, cells: int):
        self.planes: list[tuple[int, float, int, int]] = []  # dimension, value, child below, child above; -1 - c is cell c
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.root = self._cut(points, cells, np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))

    def _cut(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if cells <= 1 or len(points) < 2 or not spread.max() > 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        d = int(spread.argmax())
        value = float(np.quantile(points[:, d], (cells // 2) / cells))
        if not (points[:, d] < value).any():
            value = float(np.nextafter(value, np.inf))
        me = len(self.planes)
        self.planes.append((d, value, 0, 0))
        below_high, above_low = high.copy(), low.copy()
        below_high[d] = above_low[d] = value
        below = self._cut(points[points[:, d] < value], cells // 2, low, below_high)
        above = self._cut(points[points[:, d] >= value], cells - cells // 2, above_low, high)
        self.planes[me] = (d, value, below, above)
        return me

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while (inner := at >= 0).any():
            for k in np.unique(at[inner]):
                d, value, below, above = self.planes[k]
                of = at == k
                at[of] = np.where(points[of, d] < value, below, above)
        return -1 - at

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from each cell's box."""
        low, high = np.array(self.low), np.array(self.high)
        out = np.zeros((len(points), len(low)))
        for d in range(points.shape[1]):
            x = points[:, d : d + 1]
            out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
        return out


class Tree:
    """The lower levels over a cell's projected points: leaves of equal size with their boxes, points in order of leaves."""

    def __init__(self, points: np.ndarray):
        leaves: list[np.ndarray] = []
        self._cut(points, np.arange(len(points)), leaves)
        self.order = np.concatenate(leaves)
        self.points = points[self.order]
        ends = np.cumsum([len(x) for x in leaves])
        self.spans = list(zip((ends - [len(x) for x in leaves]).tolist(), ends.tolist()))
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def _cut(self, points: np.ndarray, of: np.ndarray, leaves: list[np.ndarray]) -> None:
        if len(of) <= LEAF:
            leaves.append(of)
            return
        here = points[of]
        d = int((here.max(axis=0) - here.min(axis=0)).argmax())
        order = np.argpartition(here[:, d], len(of) // 2)
        self._cut(points, of[order[: len(of) // 2]], leaves)
        self._cut(points, of[order[len(of) // 2 :]], leaves)

    def search(self, query: np.ndarray, projected: np.ndarray, vectors: np.ndarray, want: int, reach: float, limit: float) -> tuple[np.ndarray, int]:
        """Places of the ``want`` nearest found, ties of the last included, and how many vectors were verified.

        Points come in order of projected distance. Each step verifies some of them and lowers ``reach``, the squared
        distance to beat; the search stops where the next point's squared projected distance is over ``limit`` times that.
        ``vectors`` are in the tree's order.
        """
        gap = np.maximum(np.maximum(self.low - projected, projected - self.high), 0)
        open_ = np.nonzero((gap * gap).sum(axis=1) <= limit * reach)[0]
        if not len(open_):
            return np.empty(0, np.int64), 0
        of = np.concatenate([np.arange(*self.spans[k]) for k in open_.tolist()])
        away = self.points[of] - projected
        away = (away * away).sum(axis=1)
        near = away <= limit * reach
        of, away = of[near], away[near]
        order = np.argsort(away, kind="stable")
        of, away = of[order], away[order]
        places, found, at, step = np.empty(0, np.int64), np.empty(0), 0, 4 * want
        while at < len(of):
            upto = min(at + step, int(np.searchsorted(away, limit * reach, "right")))
            if upto <= at:
                break
            places, found = np.concatenate([places, of[at:upto]]), np.concatenate([found, 2 - 2 * (vectors[of[at:upto]] @ query)])
            at, step = upto, 2 * step
            if len(found) >= want:
                last = np.partition(found, want - 1)[want - 1]
                keep = found <= last + TIE
                places, found, reach = places[keep], found[keep], min(reach, max(last, TIE))
        return places, at


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row alone, so that equal vectors have equal results."""
    a, q = unit(vectors), unit(query[None, :])[0]
    return (a * q).sum(axis=1)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by cosine of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Rows whose vector is null, empty, zero or has null or non-finite components take no part, nor do rows with a null
    id. Vectors of different lengths have no cosine: each length is searched for itself, all rows of a length against
    that length's queries. Ties go to the smaller id. Equal vectors are searched once, whatever their number; a row is no
    neighbour of itself, though its copies are. Rows repeated with their id ask once. Fewer rows than ``k + 1`` give all
    there are. An empty table gives no rows; other columns don't matter, whatever their names.
    """
    spark = vectors.sparkSession
    found = [_nearest(rows, d, k, every)[0] for rows, d in _by_length(vectors, id_col, vector_col)]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for one in found:
        out = out.unionByName(one)
    return found[0] if len(found) == 1 else out


def verified_share(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of all pairs of a query and a vector that the search verifies."""
    seen = pairs = 0
    for rows, d in _by_length(vectors, id_col, vector_col):
        _, verified, n = _nearest(rows, d, k, every)
        total, queries = verified.agg(F.sum("verified"), F.countDistinct("key")).first()
        seen, pairs = seen + (total or 0), pairs + n * queries
    return seen / pairs if pairs else 0.0


def _by_length(vectors: DataFrame, id_col: str, vector_col: str) -> list[tuple[DataFrame, int]]:
    """Rows (id, vector) that take part, by length of their vectors. Lengths are collected: one row each."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>").alias("vector"))
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = [r["d"] for r in rows.select(F.size("vector").alias("d")).distinct().orderBy("d").collect()]
    return [(rows.where(F.size("vector") == d), d) for d in sizes]


def _nearest(rows: DataFrame, dimension: int, k: int, every: int) -> tuple[DataFrame, DataFrame, int]:
    """The result of :func:`nearest` over rows of one length, a table (key, verified) of searches, and the number of distinct vectors."""
    spark, want = rows.sparkSession, k + 1
    kind = rows.schema["vector"].dataType.simpleString()
    # equal vectors once, with their smallest ids; the limit is applied before the shuffle too
    first = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= want)
    distinct = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = written(distinct.select(F.concat_ws(":", F.col("ids")[0], F.xxhash64("vector")).alias("key"), "vector", "ids"), "ann-vectors")
    n = distinct.count()
    sample = distinct.select("vector").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()  # bounded by SAMPLE
    matrix = projection(dimension)
    size = min(MOST_CELL, max(CELL, n // 64))
    splits = Splits(unit(np.array(sample["vector"].tolist())) @ matrix, max(1, min(CELLS, -(-n // size))))
    salts = max(1, -(-n // (size * len(splits.low))))
    limit = chi_square_point(CONFIDENCE, DIMENSIONS)

    def rows_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.cell(unit(rows_of(b.column("vector"))) @ matrix).astype(np.int32))], [*b.schema.names, "cell"])

    index = distinct.mapInArrow(celled, f"key string, vector {kind}, ids array<long>, cell int")
    index = written(index.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")), "ann-index")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "vector"])
    queries = written(index.join(asked.select("vector").distinct(), "vector", "left_semi").select("key", "vector", "cell"), "ann-queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows by cell and salt: points first, of which a tree is made, then the queries, one after another."""
        at, held, tree, directions, raw, ids = None, [], None, None, None, None
        for batch in batches:
            group = batch.column("cell").to_numpy().astype(np.int64) * (1 << 32) + batch.column("salt").to_numpy() * 2 + batch.column("asks").to_numpy()
            edges = [0, *(np.nonzero(group[1:] != group[:-1])[0] + 1).tolist(), len(group)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                part, now, asks = batch.slice(lo, hi - lo), int(group[lo]) >> 1, int(group[lo]) & 1
                if now != at:
                    at, held, tree = now, [], None
                if not asks:
                    held.append(part)
                    continue
                if not held and tree is None:
                    continue  # a cell without points
                if tree is None:
                    raw = np.concatenate([rows_of(x.column("vector")) for x in held])
                    directions = unit(raw)
                    tree = Tree(directions @ matrix)
                    ids = [i for x in held for i in x.column("ids").to_pylist()]
                    raw, directions, ids, held = raw[tree.order], directions[tree.order], [ids[i] for i in tree.order.tolist()], []
                found: list[tuple] = []
                asked_, reaches = rows_of(part.column("vector")), part.column("reach").to_pylist()
                units = unit(asked_)
                projected = units @ matrix
                for i, key in enumerate(part.column("key").to_pylist()):
                    places, verified = tree.search(units[i], projected[i], directions, want, reaches[i], limit)
                    best = sorted((-x, one) for x, p in zip(cosines(raw[places], asked_[i]).tolist(), places.tolist()) for one in ids[p])[:want]
                    found.append((key, verified, [one for _, one in best], [-x for x, _ in best]))
                columns = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "verified", "ids", "scores"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(splits.low) * salts)

    def visit(routed: DataFrame, label: str) -> DataFrame:
        """Searches the cells to which the queries are routed (key, vector, cell, reach). The index is dealt once, whatever the number of queries."""
        points = index.select("cell", "salt", F.lit(0).alias("asks"), "key", "vector", "ids", F.lit(0.0).alias("reach"))
        salted = routed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        asks = salted.select("cell", "salt", F.lit(1).alias("asks"), "key", "vector", F.lit(None).cast("array<long>").alias("ids"), "reach")
        dealt = points.unionByName(asks).repartition(parts, "cell", "salt").sortWithinPartitions("cell", "salt", "asks", "key")
        return written(dealt.mapInArrow(search, "key string, verified long, ids array<long>, scores array<double>"), label)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
        pairs = found.select("key", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))).alias("p")).select("key", "p.id", "p.score")
        return pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= want).drop("_k")

    own = visit(queries.withColumn("reach", F.lit(8.0)), "ann-own")
    reached = best(own).groupBy("key").agg(F.min("score").alias("_low"), F.count(F.lit(1)).alias("_n"))
    reached = reached.select("key", F.when(F.col("_n") >= want, 2 - 2 * F.col("_low")).otherwise(8.0).alias("reach"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                q = b.slice(at, 1000)
                bounds = splits.bounds(unit(rows_of(q.column("vector"))) @ matrix)
                go = bounds <= limit * np.maximum(q.column("reach").to_numpy(), TIE)[:, None]
                go[np.arange(q.num_rows), q.column("cell").to_numpy()] = False
                row, cell = np.nonzero(go)
                q = q.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([q.column("key"), q.column("vector"), pa.array(cell.astype(np.int32)), q.column("reach")], ["key", "vector", "cell", "reach"])

    routed = queries.join(reached, "key").select("key", "vector", "cell", "reach").mapInArrow(route, f"key string, vector {kind}, cell int, reach double")
    every_visit = own.unionByName(visit(written(routed, "ann-routed"), "ann-others"))
    found = best(every_visit)
    # back to the rows that ask: each asks with its own id left out
    keyed = asked.join(queries.select("key", F.col("vector").alias("_v")), F.col("vector") == F.col("_v")).select(F.col("id").alias("query_id"), "key")
    pairs = keyed.join(found, "key")
    itself = F.row_number().over(Window.partitionBy("query_id", "key", "id").orderBy("id")) == 1
    pairs = pairs.withColumn("_own", (F.col("id") == F.col("query_id")) & itself).where("NOT _own")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    return out, every_visit.select("key", "verified"), n
