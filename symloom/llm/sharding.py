"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, a region has racks, a rack has shards with weights. A row descends the three levels; at each it
goes to the child with the smallest ``-ln(u) / weight``, where ``u`` is a uniform hash of the row's key and the
child's name, and a subtree's weight is the sum of its shards' weights. So a child gets rows in proportion to its
weight, and a changed weight moves rows only into or out of the subtrees on the path to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, prefix_sums

#: Shards in a rack and racks in a region of a tree made by :func:`even_tree`, and shards with which a tree is founded.
RACK, REGION, FOUNDED = 4, 2, 16


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, rack: int = RACK, region: int = REGION) -> list[Shard]:
    """A tree of equal shards, filled rack by rack and region by region."""
    return [Shard(s, f"g{s // (rack * region)}", f"r{s // rack}") for s in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` with one more shard in a region of its own.

    No existing subtree's weight changes, so rows move into the new shard alone.
    """
    n = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(n, f"g+{n}", f"r+{n}", weight)]


def standard_tree(shards: int) -> list[Shard]:
    """The tree of so many shards: ``FOUNDED`` equal ones in racks and regions, and each later one grown by :func:`grown`.

    So the tree of n + 1 shards is the grown tree of n. Fewer than ``FOUNDED`` are each grown; only the step to
    ``FOUNDED`` itself founds the tree anew.
    """
    tree = even_tree(FOUNDED) if shards >= FOUNDED else []
    while len(tree) < shards:
        tree = grown(tree)
    return tree


def _uniform(key: Column, label: Column) -> Column:
    """A hash of key and label in (0, 1), of 52 bits."""
    return (F.shiftrightunsigned(F.xxhash64(key, label), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def _draw(key: Column, options: Column) -> Column:
    """What is below the option (name, weight, below) with the smallest weighted draw; of equal draws the first."""
    draws = F.transform(options, lambda o, i: F.struct((-F.log(_uniform(key, o["name"])) / o["weight"]).alias("d"), i.alias("i"), o["below"].alias("below")))
    return F.array_min(draws)["below"]


def place(df: DataFrame, tree: list[Shard], key: Column, out: str) -> DataFrame:
    """Adds ``out``, the int number of each row's shard. A null key is a key like any other.

    The tree is one literal and each level one draw over an array, so the plan doesn't grow with the tree.
    """
    tree = [s for s in tree if s.weight > 0]
    if not tree:
        raise ValueError("the tree has no shard with a weight over 0")

    def option(name: str, shards: list[Shard], below: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(float(sum(s.weight for s in shards))).alias("weight"), below.alias("below"))

    def split(shards: list[Shard], level: str) -> list[tuple[str, list[Shard]]]:
        found: dict[str, list[Shard]] = {}
        for s in shards:
            found.setdefault(getattr(s, level), []).append(s)
        return list(found.items())

    def racks(shards: list[Shard]) -> Column:
        return F.array(*[option(f"rack {k}", v, F.array(*[option(f"shard {s.number}", [s], F.lit(s.number)) for s in v])) for k, v in split(shards, "rack")])

    regions = F.array(*[option(f"region {k}", v, racks(v)) for k, v in split(tree, "region")])
    return df.withColumn(out, _draw(key, _draw(key, _draw(key, regions))).cast("int"))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows: int | None = None) -> DataFrame:
    """Assigns documents to ``shards`` equal shards under the ``key`` law: id and tree alone decide.

    Returns id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot (gapless from 0 in a shard) and
    grown_shard, the shard in the tree with one more: what this function gives as shard for ``shards + 1``.

    Null text has size 1 and the checksum of no bytes. Null ids share one shard. Repeated rows are kept, go to one
    shard and get a slot each. An empty table gives no rows. Other columns of the input don't matter.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    tree = standard_tree(shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(base, tree, F.col("doc_id"), "shard")
    rows = docs.count() if rows is None else rows
    # 16 buckets a shard at least, so that a slot range is never one task's work
    out = prefix_sums(placed, ["shard"], ["doc_id", "text_crc32"], {"slot": F.lit(1)}, buckets_for(rows, 512))
    out = place(out, standard_tree(shards + 1), F.col("doc_id"), "grown_shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
