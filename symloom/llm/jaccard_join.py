"""Exact Jaccard join of documents on word shingles, by size-banded tiles with bitmap signatures.

Documents with equal shingle sets become one set. Sets are ordered by hash, with shingles of very many documents last;
two sets over the threshold share a shingle among the first of each, so the runs of a shingle hold all candidates. A
run is sorted by size and cut into tiles, and only tiles whose sizes allow the threshold meet. In a tile, the bits in
which two parity bitmaps differ bound the overlap from above; what stays is intersected exactly from sorted arrays.

A group of thousands of near copies would give as many pairs as its square. So each run's members are first compared
with the run's first set alone, then each set with the likeliest of those that are apart from it. Sets that these links
join need no further comparison with each other, and runs are tiled only for pairs of sets that are still apart. No link between components is lost that way.
That gives the components (:func:`similar`). All links lie within components: :func:`linked_pairs` and :func:`joined`
compare all pairs of a component whose sizes allow a link, in tiles of bounded size, each pair once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, small_batches, written

#: Shingles of at least this part of all documents, and of FREQUENT documents, come last in the order; at most LISTED of
#: them are listed. What is listed changes the work, not the result.
FREQUENT_PART, FREQUENT, LISTED = 1 / 1000, 64, 1_000_000
#: Shingles that a task gathers before it counts them, words whose hashes and sets whose shingles it keeps.
GATHER, CACHE, SEEN = 1_000_000, 200_000, 100_000
#: Bits of a bitmap: the next power of two over the set's size, within these. With fewer, sets far under the threshold pass.
LEAST_BITS, MOST_BITS = 128, 16384
TILE = 1024
#: Shingles in a tile of a component at most (a longer set is a tile of its own), sets that have a rare shingle at most,
#: columns of an incidence matrix, and partners of a first set that go to one task.
TILE_SHINGLES, RARE, COLUMNS, STAR = 300_000, 6, 2048, 512
#: Up to this many bands of large components are sent to every executor.
BROADCAST_BANDS = 100_000
#: Runs of up to so many sets are paired without tiles.
SMALL_RUN = 8
#: Up to this many ids are sent to every executor to pick their documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_A = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = xxhash.xxh3_64_digest(word)
        return found


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of ``k`` words."""

    def __init__(self, k: int):
        self.k, self.known = k, _Hashes()

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        h = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint64)
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.full(n, np.uint64(k), np.uint64)
        for i in range(k):  # arrays of unsigned numbers wrap around
            out *= _A
            out += h[i : i + n]
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
        out.sort()
        if n > 1 and (again := out[1:] == out[:-1]).any():
            out = out[np.concatenate([[True], ~again])]
        return out


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the shingles' counts by bucket. Two sets differ in at least as many elements as bitmaps in bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(len(shingles), 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(x: int, bits: int, to: int) -> int:
    """The bitmap of ``to`` bits from one of ``bits``."""
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def sizes_allow(a: int, b: int, percent: int) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


def overlap_allows(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def prefix(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the common order, one of which a set over the threshold shares."""
    n = len(shingles)
    least = -(-percent * n // 100)  # the overlap with any partner is no less
    keep = n - least + 1
    if len(frequent):
        at = np.searchsorted(frequent, shingles)
        often = frequent[np.minimum(at, len(frequent) - 1)] == shingles
        if often.any():
            return np.concatenate([shingles[~often], shingles[often]])[:keep]
    return shingles[:keep]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def tile_pairs(sizes: np.ndarray, maps: list[bytes], groups: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs of a run, sorted by size, of different groups, whose sizes and bitmaps allow the threshold.

    The third array has bounds of their similarity, in thousandths.
    """
    n = len(sizes)
    if n <= 12:
        ints = [int.from_bytes(m, "little") for m in maps]
        found = []
        for j in range(1, n):
            for i in range(j - 1, -1, -1):
                a, b = int(sizes[i]), int(sizes[j])
                if 100 * a < percent * b:
                    break
                if groups[i] != groups[j]:
                    to = 8 * len(maps[i])
                    differ = (ints[i] ^ fold(ints[j], 8 * len(maps[j]), to)).bit_count()
                    most = (a + b - differ) // 2
                    if overlap_allows(most, a, b, percent):
                        found.append((i, j, 1000 * most // (a + b - most)))
        if found:
            pairs = np.array(found)
            yield pairs[:, 0], pairs[:, 1], pairs[:, 2]
        return
    # sizes ascend, and bitmaps with them: one table for each length of bitmap
    widths = np.array([len(m) for m in maps])
    bounds = np.concatenate([[0], np.nonzero(widths[1:] != widths[:-1])[0] + 1, [n]]).tolist()
    tables = [(lo, hi, np.frombuffer(b"".join(maps[lo:hi]), np.uint64).reshape(hi - lo, -1)) for lo, hi in zip(bounds[:-1], bounds[1:])]
    for lo in range(0, n, TILE):
        hi = min(lo + TILE, n)
        for left in range(0, lo + 1, TILE):
            right = min(left + TILE, n)
            if 100 * int(sizes[right - 1]) < percent * int(sizes[lo]):
                continue  # the tiles' sizes are too far apart
            for j in range(max(lo, left + 1), hi):
                first = max(left, int(np.searchsorted(sizes, -(-percent * int(sizes[j]) // 100))))
                for at, upto, table in tables:
                    start, end = max(first, at), min(right, j, upto)
                    if start >= end:
                        continue
                    bits = 64 * table.shape[1]
                    mine = maps[j] if 8 * len(maps[j]) == bits else fold(int.from_bytes(maps[j], "little"), 8 * len(maps[j]), bits).to_bytes(bits // 8, "little")
                    differ = np.bitwise_count(table[start - at : end - at] ^ np.frombuffer(mine, np.uint64)).sum(axis=1).astype(np.int64)
                    both = sizes[start:end] + sizes[j]
                    most = (both - differ) // 2
                    ok = (100 * most >= percent * (both - most)) & (groups[start:end] != groups[j])
                    if ok.any():
                        i = np.nonzero(ok)[0] + start
                        yield i, np.full(len(i), j), (1000 * most // (both - most))[ok]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Tables of whole runs of equal keys from batches sorted by key."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column("key").to_numpy()
        if keys[0] == keys[-1]:
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        yield held.slice(0, cut)
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def similar(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every document.

    Two documents link when 100 times the size of the intersection of their sets of ``k``-word shingles is at least
    ``percent`` times that of the union. Texts of fewer words have their whole sequence as the one shingle. Null and
    blank texts have none and link with nothing. Documents with null ids link, but give no component their id;
    repeated rows are rows of their own. An empty table gives no rows. With ``row_col``, a key of rows with equal ids and
    texts: also this key as row and, where there are shingles, the component's smallest set as label.
    """
    sets, labels, _ = _sets(docs, k, percent, id_col, text_col, row_col)
    out = _labelled(sets, labels)
    return out.select("doc_id", "n_shingles", "component_id", *(["row", "label"] if row_col else []))


def linked_pairs(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' sets (doc_id, row, n_shingles, set_id) and all linked pairs (a < b) of different sets, each once."""
    sets, labels, arrays = _sets(docs, k, percent, id_col, text_col)
    dealt = _dealt(labels, arrays, sets, percent)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for me, other, _, _, hit in _tiles(batches, percent):
            a, b = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(me[a], other[b])), pa.array(np.maximum(me[a], other[b]))], ["a", "b"])

    return sets.select("doc_id", "row", "n_shingles", "set_id"), dealt.mapInArrow(pairs, "a long, b long")


def joined(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`similar` gives, with n_links: the number of other rows that a document links with.

    All pairs of different sets in a component are compared, in tiles; a linked set counts as often as rows have it, and
    rows of an equal set link with each other.
    """
    sets, labels, arrays = _sets(docs, k, percent, id_col, text_col)
    dealt = _dealt(labels, arrays, sets, percent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for me, other, copies, other_copies, hit in _tiles(batches, percent):
            both = np.concatenate([me, other]), np.concatenate([hit @ other_copies, copies @ hit])
            some = both[1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in both], ["node", "linked"])

    linked = dealt.mapInArrow(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))
    copies = sets.where("n_shingles > 0").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"))
    counts = copies.join(linked, F.col("set_id") == F.col("node"), "left").select(F.col("set_id").alias("_n"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = _labelled(sets, labels).join(counts, F.col("set_id") == F.col("_n"), "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _dealt(labels: DataFrame, arrays: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The sets of each component (node, label), dealt to work items in which every pair of sets that sizes allow meets once.

    A small component is one item. A large one is cut into bands of sizes, so wide that only neighbouring ones can link,
    and bands by hash into tiles of bounded size; an item is a pair of tiles (side 0 and 1) or one tile (side 0 alone).
    """
    copies = sets.where("n_shingles > 0").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.001))
    members = labels.join(copies, F.col("node") == F.col("set_id")).select("label", "set_id", "n", "copies", band.alias("band"))
    members = written(members, "join-members")
    cut = lambda count, total: F.greatest(F.ceil(count / TILE), F.ceil(total / TILE_SHINGLES))
    bands = members.groupBy("label", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    along = Window.partitionBy("label").orderBy("band")
    beside = lambda f, d: F.when(f("band").over(along) == F.col("band") + d, f("tiles").over(along)).otherwise(0)
    whole = Window.partitionBy("label")
    bands = bands.withColumn("tiles", cut(F.col("c"), F.col("t"))).withColumn("_large", cut(F.sum("c").over(whole), F.sum("t").over(whole)) > 1)
    bands = bands.withColumn("below", beside(F.lag, -1)).withColumn("above", beside(F.lead, 1)).where("_large")
    bands = written(bands.select(F.col("label").alias("_l"), F.col("band").alias("_b"), "tiles", "below", "above"), "join-bands")
    few = bands.count() <= BROADCAST_BANDS
    at = members.join(F.broadcast(bands) if few else bands, (F.col("label") == F.col("_l")) & (F.col("band") == F.col("_b")), "left")
    at = at.withColumn("tile", F.pmod(F.xxhash64("set_id"), F.coalesce("tiles", F.lit(1)).cast("long")))
    item = lambda b, i, c, j, side: F.struct(b.cast("long").alias("b"), i.cast("long").alias("i"), c.cast("long").alias("c"), j.cast("long").alias("j"), F.lit(side).alias("side"))
    count = lambda n, f: F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>")), f)
    b, i = F.col("band"), F.col("tile")
    # with the tiles from its own on, with those before, and with all of the bands beside
    items = F.concat(
        count(F.col("tiles") - i, lambda x: item(b, i, b, i + x, 0)),
        count(i, lambda x: item(b, x, b, i, 1)),
        count(F.col("above"), lambda x: item(b, i, b + 1, x, 0)),
        count(F.col("below"), lambda x: item(b - 1, x, b, i, 1)),
    )
    zero = F.lit(0)
    items = F.when(F.col("tiles").isNull(), F.array(item(zero, zero, zero, zero, 0))).otherwise(items)
    dealt = at.select("label", "set_id", "copies", F.explode(items).alias("w")).select("label", "w.*", "set_id", "copies")
    arrays = arrays.dropDuplicates(["set_id"]).select(F.col("set_id").alias("_s"), "shingles")
    dealt = dealt.join(arrays, F.col("set_id") == F.col("_s")).drop("_s")
    parts, by = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["label", "b", "i", "c", "j"]
    return dealt.select(*by, "side", "set_id", "copies", "shingles").repartition(parts, *by).sortWithinPartitions(*by, "side", "set_id")


def _tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each work item: the sets and copies of its two sides, and which pairs link (pairs within one side above the diagonal)."""

    def done(rows: list[tuple]) -> Iterator[tuple]:
        sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
        if not sides[0] or (rows[0][4] and not sides[1]):
            return
        a, b = ([np.frombuffer(r[3], np.uint64) for r in side] for side in sides)
        hit = linked_matrix(a, b or None, percent)
        if hit.any():
            me, copies = (np.array([r[x] for r in sides[0]], np.int64) for x in (1, 2))
            other, other_copies = (np.array([r[x] for r in sides[1]], np.int64) for x in (1, 2)) if b else (me, copies)
            yield me, other, copies, other_copies, hit

    at, rows = None, []
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for n, key in enumerate(zip(*(columns[c] for c in ("label", "b", "i", "c", "j")))):
            if key != at:
                if rows:
                    yield from done(rows)
                at, rows = key, []
            two = key[1:3] != key[3:5]
            rows.append((columns["side"][n], columns["set_id"][n], columns["copies"][n], columns["shingles"][n], two))
    if rows:
        yield from done(rows)


def linked_matrix(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of ``a`` link with which of ``b`` (with later ones of ``a``, if ``b`` is None), by exact intersections.

    Hashed bitmaps bound the overlap from above; if some pair passes, shingles that at least two sets have are counted pair
    by pair: rare ones by listing their pairs of sets, the others by products of incidence matrices.
    """
    one = b is None
    b = a if one else b
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = n[:, None] + m[None, :]
    open_ = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    if one:
        open_ &= np.arange(len(a))[:, None] < np.arange(len(a))[None, :]
    if len(a) * len(b) <= 64:  # a few sets: bitmaps, then one pair after another
        hit = np.zeros_like(open_)
        maps = {id(x): int.from_bytes(bitmap(x), "little") for x in (*a, *b)}
        width = lambda x: 8 * len(bitmap(x))
        for i, j in zip(*np.nonzero(open_)):
            x, y = a[i], b[j]
            to = min(width(x), width(y))
            differ = (fold(maps[id(x)], width(x), to) ^ fold(maps[id(y)], width(y), to)).bit_count()
            most = (len(x) + len(y) - differ) // 2
            hit[i, j] = overlap_allows(most, len(x), len(y), percent) and overlap_allows(overlap(x, y), len(x), len(y), percent)
        return hit
    sides = a if one else [*a, *b]
    bits = 8 * len(bitmap(min(sides, key=len)))
    table = np.array([np.frombuffer(fold(int.from_bytes(y, "little"), 8 * len(y), bits).to_bytes(bits // 8, "little"), np.uint64) for y in map(bitmap, sides)])
    for i in range(len(a)):
        differ = np.bitwise_count(table[0 if one else len(a) :] ^ table[i]).sum(axis=1, dtype=np.int64)
        most = (both[i] - differ) // 2
        open_[i] &= 100 * most >= percent * (both[i] - most)
    if not open_.any():
        return open_
    row = np.repeat(np.arange(len(sides)), [len(x) for x in sides])
    values = np.concatenate(sides)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(first) - 1
    starts = np.nonzero(first)[0]
    counts = np.diff(np.append(starts, len(values)))
    inter = np.zeros((len(a), len(b)), np.int32)
    flat, shift = inter.ravel(), 0 if one else len(a)
    for c in range(2, RARE + 1):
        rows = row[starts[counts == c][:, None] + np.arange(c)]  # ascending in each shingle
        for p in range(c):
            for q in range(p + 1, c):
                x, y = rows[:, p], rows[:, q] - shift
                ok = slice(None) if one else (x < len(a)) & (y >= 0)
                np.add.at(flat, x[ok] * len(b) + y[ok], 1)
    often = np.cumsum(counts > RARE) - 1
    dense = (counts > RARE)[column]
    row, column = row[dense], often[column[dense]]
    for at in range(0, int(often[-1]) + 1 if len(often) else 0, COLUMNS):
        here = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        table = np.zeros((len(sides), COLUMNS), np.float32)
        table[row[here], column[here] - at] = 1
        inter += (table[: len(a)] @ table[shift:].T).astype(np.int32)
    return open_ & (100 * inter >= percent * (both - inter))


def _labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id, row and label (the component's smallest set) of every document; without shingles no set and label."""
    named = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("_least"))
    named = named.join(labels, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("label", "set_id").alias("_label"), "_least")
    least = named.groupBy(F.col("_label").alias("_l")).agg(F.min("_least").alias("component_id"))
    final = named.join(least, F.col("_label") == F.col("_l")).select(F.col("set_id").alias("_s"), "component_id", F.col("_label").alias("label"))
    out = sets.where("n_shingles > 0").join(final, F.col("set_id") == F.col("_s")).select("doc_id", "n_shingles", "component_id", "set_id", "row", "label")
    return out.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("set_id"), "row", F.lit(None).cast("long").alias("label")))


def _sets(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets (doc_id, n_shingles, set_id, ...) of all documents, labels (node, label) of the components of linked sets,
    and the sorted arrays (set_id, shingles) of all linked sets, some of them repeated."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(k)
        ids, rows, found, maps, total = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            every, counts = np.unique(np.concatenate(found), return_counts=True)
            often = counts >= max(4, FREQUENT_PART / 2 * len(found))
            # what is frequent here stands in the first row
            hot = [[{"s": a, "n": b} for a, b in zip(every[often].astype(np.int64).tolist(), counts[often].tolist())], *[None] * (len(found) - 1)]
            kinds = pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int64())]))
            columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([set_id(s) for s in found], pa.int64()), pa.array(maps, pa.binary()), pa.array([hot[0] or None, *hot[1:]], kinds)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "set_id", "map", "hot"])

        for batch in batches:
            for text, doc_id, row in zip(batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()):
                s = make.of(text.as_py())
                ids.append(doc_id), rows.append(row), found.append(s), maps.append(bitmap(s) if len(s) else b"")
                total += len(s)
                if total >= GATHER or len(found) >= 4000:
                    yield out()
                    ids, rows, found, maps, total = [], [], [], [], 0
        if found:
            yield out()

    sets = written(base.mapInArrow(gather, "doc_id long, row long, n_shingles long, set_id long, map binary, hot array<struct<s: long, n: long>>"), "join-sets")
    n_docs = sets.count()
    often = sets.where("hot IS NOT NULL").select(F.explode("hot").alias("h")).groupBy("h.s").agg(F.sum("h.n").alias("n")).where(F.col("n") >= max(FREQUENT, n_docs * FREQUENT_PART)).orderBy(F.desc("n"), "s").limit(LISTED)
    frequent = np.sort(np.array([r["s"] for r in often.select("s").collect()], np.int64).astype(np.uint64))
    shared = spark.sparkContext.broadcast(frequent)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(k), set()
        for batch in batches:
            keys, ids, sizes = [], [], []
            for text in batch.column("text"):
                s = make.of(text.as_py())
                if not len(s):
                    continue
                me = set_id(s)
                if me in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(me)
                p = prefix(s, shared.value, percent)
                keys.append(p.astype(np.int64))
                ids.append(np.full(len(p), me, np.int64))
                sizes.append(np.full(len(p), len(s), np.int32))
                if len(keys) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, sizes)], ["key", "set_id", "n"])
                    keys, ids, sizes = [], [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, sizes)], ["key", "set_id", "n"])

    def runs_of_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key, size and set: those in runs of more than one set, with the run's first set.

        A run ends with its key, and where the next size is too large for the threshold: no pair spans such a gap.
        """
        before = None  # the row before: key, set, size
        first, waits = (0, 0), False  # the open run's first set and size, and whether that set is still to be given out
        for batch in batches:
            key, me, n = (batch.column(c).to_numpy() for c in ("key", "set_id", "n"))
            if not len(key):
                continue
            last = before or (key[0] + 1 if key[0] < 0 else key[0] - 1, me[0], n[0])
            key0, me0, n0 = (np.concatenate([[v], x[:-1]]) for v, x in zip(last, (key, me, n)))
            fresh = (key != key0) | (me != me0)
            key, me, n, key0, n0 = key[fresh], me[fresh], n[fresh], key0[fresh], n0[fresh]
            if not len(key):
                continue
            opens = (key != key0) | (100 * n0 < percent * n)
            at = np.maximum.accumulate(np.where(opens, np.arange(len(key)), -1))
            first_me, first_n = np.where(at < 0, first[0], me[at]), np.where(at < 0, first[1], n[at])
            member = ~opens
            given = np.nonzero(opens[:-1] & member[1:])[0]  # first sets whose run goes on
            lead = [(key[0], first[0], first[0], first[1])] if waits and member[0] else []
            out = [np.concatenate([x[member], x[given], np.array([r[i] for r in lead], np.int64)]) for i, x in enumerate((key, me, first_me, first_n))]
            out[2][int(member.sum()) : int(member.sum()) + len(given)] = me[given]
            out[3][int(member.sum()) : int(member.sum()) + len(given)] = n[given]
            tail = int(at[-1])
            first, waits = (int(first_me[-1]), int(first_n[-1])), tail == len(key) - 1
            before = (key[-1], me[-1], n[-1])
            if len(out[0]):
                run = (out[0].astype(np.uint64) ^ (out[3].astype(np.uint64) * _A)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(out[1]), pa.array(out[2])], ["key", "set_id", "first"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread_out = base.mapInArrow(spread, "key long, set_id long, n int").repartition(parts, "key").sortWithinPartitions("key", "n", "set_id")
    runs = written(spread_out.mapInArrow(runs_of_many, "key long, set_id long, first long"), "join-runs")
    one = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("map").alias("map"))
    one = written(one, "join-one")

    stars = runs.where("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b")).distinct()
    stars = written(_bounded(stars, one, percent), "join-stars")
    links, arrays = _verify(stars, base, one, k, percent)
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = components(links)
    # Then each set that is still apart from others in its runs tries the likeliest of them, and at last all are tried.
    for best in (True, False):
        pairs = _apart(runs, labels, one, percent, best, parts).join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "join-pairs")
        links, more = _verify(pairs, base, one, k, percent)
        labels, arrays, tried = components(links, labels), arrays.unionByName(more), tried.unionByName(pairs)
    return sets, written(labels, "join-labels"), arrays


def _apart(runs: DataFrame, labels: DataFrame, one: DataFrame, percent: int, best: bool, parts: int) -> DataFrame:
    """Pairs (a, b) of sets in one run, of different components, that sizes and bitmaps allow.

    ``best``: for each set the likeliest, from runs of many sets alone.
    """
    grouped = runs.select("key", "set_id").join(labels, F.col("set_id") == F.col("node"), "left").select("key", "set_id", F.coalesce("label", "set_id").alias("group"))
    grouped = written(grouped, "join-grouped")
    mixed = grouped.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("many")).where("lo < hi").select(F.col("key").alias("_key"), F.col("many") > SMALL_RUN)
    mixed = mixed.toDF("_key", "large")
    apart = grouped.join(mixed.where("large"), F.col("key") == F.col("_key"), "left_semi").join(one.select(F.col("set_id").alias("_s"), "n", "map"), F.col("set_id") == F.col("_s"))
    apart = apart.select("key", "set_id", "group", "n", "map").repartition(parts, "key").sortWithinPartitions("key", "n", "set_id")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            keys, me = table.column("key").to_numpy(), table.column("set_id").to_numpy()
            group, size, maps = table.column("group").to_numpy(), table.column("n").to_numpy(), table.column("map").to_pylist()
            edges = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
            out = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for i, j, bound in tile_pairs(size[lo:hi], maps[lo:hi], group[lo:hi], percent):
                    if best:  # of those with the same j
                        top = np.lexsort((i, -bound, j))
                        top = top[np.concatenate([[True], j[top][1:] != j[top][:-1]])]
                        i, j, bound = i[top], j[top], bound[top]
                    x, y = me[lo + i], me[lo + j]
                    out.append(np.stack([np.minimum(x, y), np.maximum(x, y), y, bound], axis=1))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, c].copy()) for c in range(4)], ["a", "b", "by", "bound"])

    pairs = apart.mapInArrow(tile, "a long, b long, by long, bound long")
    if best:
        return pairs.groupBy("by").agg(F.max_by(F.struct("a", "b"), F.struct("bound", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    # runs of a few sets: their pairs are fewer than the bitmaps that a tile would need
    few = grouped.join(mixed.where("NOT large"), F.col("key") == F.col("_key"), "left_semi")
    both = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.group") != F.col("y.group")))
    small = both.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()
    return pairs.select("a", "b").unionByName(_bounded(small, one, percent)).distinct()


def _bounded(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps allow the threshold."""
    side = lambda x: one.select(F.col("set_id").alias(f"_{x}"), F.col("n").alias(f"n_{x}"), F.col("map").alias(f"map_{x}"))
    joined = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    joined = joined.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "map_a", "map_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("map_a", "map_b", "n_a", "n_b"))):
                to = 8 * min(len(m), len(n))
                differ = (fold(int.from_bytes(m, "little"), 8 * len(m), to) ^ fold(int.from_bytes(n, "little"), 8 * len(n), to)).bit_count()
                ok.append(overlap_allows((x + y - differ) // 2, x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(keep, "a long, b long")


def _verify(pairs: DataFrame, base: DataFrame, one: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs over the threshold, by exact intersection of the sets' sorted arrays, and the arrays (set_id, shingles) of these pairs' sets.

    A first set with many partners is dealt with them to several tasks.
    """
    spark = pairs.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = written(one.join(wanted, "set_id", "left_semi").select("set_id", "doc_id"), "join-wanted")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    few = wanted.count() <= BROADCAST_IDS
    chosen = base.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [s for t in batch.column("text").slice(at, 500) if len(s := make.of(t.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["set_id", "shingles"])

    sets = written(chosen.mapInArrow(arrays, "set_id long, shingles binary"), "join-arrays")
    many = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / STAR).alias("salts")).where("salts > 1")
    salted = pairs.join(many, F.col("a") == F.col("_a"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)).cast("long")).alias("salt"))
    sides = salted.select(F.col("a").alias("key"), "salt", F.col("b").alias("other")).unionByName(salted.select(F.col("a").alias("key"), "salt", F.lit(None).cast("long").alias("other")).distinct())
    # a row for each pair's second set, and one with no other for the first; all of a first set's rows of a salt come together
    rows = sides.withColumn("of", F.coalesce("other", "key")).join(sets, F.col("of") == F.col("set_id")).select("key", "salt", "other", "shingles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", F.col("other").asc_nulls_first())

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for key, other, raw in zip(batch.column("key").to_pylist(), batch.column("other").to_pylist(), batch.column("shingles").to_pylist()):
                s = np.frombuffer(raw, np.uint64)
                if other is None:
                    now, mine = key, s.copy()
                elif key == now and overlap_allows(overlap(mine, s), len(mine), len(s), percent):
                    a.append(key)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = written(rows.mapInArrow(intersect, "a long, b long"), "join-links")
    linked = links.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    return links, sets.join(linked, "set_id", "left_semi")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes of ``links`` (a, b), by large and small stars.

    ``known``: labels of some of the nodes, whose components the links may join; only joined ones are worked on.
    """
    if known is None:
        return _stars(links)
    known = written(known, "labels")
    to = lambda x: known.select(F.col("node").alias(f"_{x}"), F.col("label").alias(f"l{x}"))
    ends = links.join(to("a"), F.col("a") == F.col("_a"), "left").join(to("b"), F.col("b") == F.col("_b"), "left")
    between = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    joined = written(_stars(between).withColumnRenamed("label", "_joined"), "labels")
    old = known.join(joined.withColumnRenamed("node", "_n"), F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_joined", "label").alias("label"))
    fresh = joined.join(known.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti").select("node", F.col("_joined").alias("label"))
    return old.unionByName(fresh)


def _stars(links: DataFrame) -> DataFrame:
    spark = links.sparkSession
    state, edges = None, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        # the count and a sum of hashes, observed while the table is written, tell when nothing changes
        seen = Observation()
        edges = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")), "stars")
        now = seen.get
        if now == state or not now["n"]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        edges = joined.select(F.col("u"), F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
    release(spark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
