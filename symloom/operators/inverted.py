"""A stored inverted index: postings by token with frequencies and lengths, replaced by document, searched by BM25.

The index is three tables in versions (``sources.versions``): ``docs`` (key, length), ``postings`` (token, block, key, tf,
length) and ``blocks`` (token, block, n, most, least), the two last ones dealt by token. A token's postings are in blocks of
falling frequency by length; of a block the largest frequency and the smallest length are kept, which bound what a posting
in it can score. A search reads the bounds first: a block is skipped if no document that has nothing better than it, and the
best of every other term, can reach the k-th best score found so far.

Null keys and texts without tokens are not indexed. Scores are rounded to six places, ties go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import drop, stored
from ..sources.versions import Versions

#: Postings of a block, and parameters of BM25.
BLOCK, K1, B = 128, 1.2, 0.75
#: Postings of a token in a bucket for ranks; a token's postings are dealt to buckets by their frequency.
TIERS = 64


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def _analysed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, length and terms (token, tf) of documents with tokens; terms are the runs of a document's sorted tokens."""
    found = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.sort_array(tokens_of(F.coalesce(F.col(text), F.lit("")))).alias("tokens"))
    found = found.select("key", F.size("tokens").alias("length"), "tokens").where("length > 0")
    at = lambda i: F.get(F.col("tokens"), i)
    found = found.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    terms = F.transform("starts", lambda i, k: F.struct(at(i).alias("token"), (F.coalesce(F.get(F.col("starts"), k + 1), F.col("length")) - i).cast("int").alias("tf")))
    return found.select("key", "length", terms.alias("terms"))


def _postings(analysed: DataFrame) -> DataFrame:
    """A row for each token of a document, without a shuffle."""
    return analysed.select("key", "length", F.explode("terms").alias("t")).select("t.token", "key", "length", "t.tf")


def _blocked(postings: DataFrame) -> DataFrame:
    """Postings with their block: tiers of like tf by length in falling order, ranks within a tier by key.

    No task holds a token's postings: blocks are counted within (token, tier, part), parts by a hash of the key.
    """
    tier = F.least(F.lit(TIERS - 1), F.floor(F.lit(TIERS) * F.col("tf") / (F.col("tf") + F.col("length") / 8.0))).cast("int")
    dealt = postings.withColumn("_tier", tier)
    # small tiers are one part: only those of more than a few blocks are met
    sizes = dealt.groupBy("token", "_tier").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 8 * BLOCK)
    sizes = stored(sizes.select("token", "_tier", F.ceil(F.col("_n") / (8 * BLOCK)).alias("_parts")), "index-sizes")
    part = F.pmod(F.pmod(F.xxhash64("key"), F.lit(1024)), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = dealt.join(sizes, ["token", "_tier"], "left").withColumn("_part", part).drop("_parts")
    rank = F.row_number().over(Window.partitionBy("token", "_tier", "_part").orderBy("key"))
    block = (F.lit(TIERS - 1) - F.col("_tier")) * F.lit(1 << 32).cast("long") + F.col("_part") * F.lit(1 << 12) + F.floor((rank - 1) / BLOCK)
    return dealt.select("token", block.cast("long").alias("block"), "key", "tf", "length")


def _bounds(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"))


def build(versions: Versions, docs: DataFrame, key: str, text: str) -> int:
    """Indexes documents; their keys differ. The first version, or one that replaces all."""
    analysed = stored(_analysed(docs, key, text), "index-docs")
    versions.put("docs", analysed.select("key", "length"), "key")
    postings = stored(_blocked(_postings(analysed)), "index-postings")
    drop(analysed)
    versions.put("postings", postings, "token", sort=["token", "block"])
    versions.put("blocks", _bounds(postings), "token", sort=["token", "block"])
    drop(postings)
    return versions.commit()


def update(versions: Versions, docs: DataFrame, key: str, text: str, deleted: DataFrame | None = None) -> int:
    """Puts documents in place of those with their keys, and takes out ``deleted`` keys; a key in both is deleted.

    Only buckets of tokens that the old or new texts hold are written again.
    """
    analysed = _analysed(docs, key, text)
    keys = docs.select(F.col(key).alias("key")).where("key IS NOT NULL")
    if deleted is not None:
        out = deleted.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
        analysed, keys = analysed.join(out, "key", "left_anti"), keys.union(out)
    analysed, keys = stored(analysed, "index-docs"), stored(keys.distinct(), "index-keys")
    old, new = versions.read("postings"), _postings(analysed)
    at = versions.touched("postings", old.join(keys, "key", "left_semi").select("token").union(new.select("token")))
    left = versions.read("postings", at).join(keys, "key", "left_anti").select("token", "key", "length", "tf")
    postings = stored(_blocked(left.unionByName(new)), "index-postings")
    versions.rewrite("postings", postings, at)
    versions.rewrite("blocks", _bounds(postings), at)
    drop(postings)
    parts = versions.touched("docs", keys)
    versions.rewrite("docs", versions.read("docs", parts).join(keys, "key", "left_anti").unionByName(analysed.select("key", "length")), parts)
    drop(analysed)
    return versions.commit()


def _worth(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def terms_of(versions: Versions, terms: list[str]) -> DataFrame:
    """token, idf, mean length and the most that one of its postings can score, for the terms that the index has."""
    totals = versions.read("docs").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    blocks = versions.read("blocks", _buckets(versions, terms)).where(F.col("token").isin(sorted(set(terms))))
    counted = blocks.groupBy("token").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(totals))  # one row
    return counted.select("token", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")


def _buckets(versions: Versions, terms: list[str]) -> list[int]:
    rows = versions.spark.createDataFrame([(t,) for t in sorted(set(terms))] or [("",)], "token STRING")
    return versions.touched("blocks", rows)


def candidate_blocks(versions: Versions, terms: list[str], k: int) -> tuple[DataFrame, int, int]:
    """The blocks of the terms that may hold a document among the ``k`` best, how many they are, and how many there are."""
    known = terms_of(versions, terms)
    blocks = versions.read("blocks", _buckets(versions, terms)).join(F.broadcast(known), "token")  # a row a term
    bounds = stored(blocks.select("token", "block", "n", "idf", "mean", _worth(F.col("idf"), F.col("most"), F.col("least"), F.col("mean")).alias("bound")), "search-bounds")
    # the terms' first blocks give scores that the k-th best can't stay under: other terms only add to them
    ahead = Window.partitionBy("token").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = bounds.withColumn("_before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("_before") < max(k, BLOCK)).select("token", "block", "idf", "mean")
    seen = _postings_of(versions, terms, first)
    scores = seen.groupBy("key").agg(F.sum(_worth(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean"))).alias("s")).orderBy(F.desc("s")).limit(k)
    low = scores.agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n")).first()  # k rows
    least = low["s"] if low["n"] == k else 0.0
    tops = bounds.groupBy("token").agg(F.max("bound").alias("top"))
    total = tops.agg(F.sum("top").alias("all"))
    reach = bounds.join(F.broadcast(tops), "token").crossJoin(F.broadcast(total)).withColumn("reach", F.col("bound") + F.col("all") - F.col("top"))
    kept = stored(reach.where(F.col("reach") >= least - 1e-6).select("token", "block", "idf", "mean"), "search-blocks")
    return kept, kept.count(), bounds.count()


def _postings_of(versions: Versions, terms: list[str], blocks: DataFrame) -> DataFrame:
    postings = versions.read("postings", _buckets(versions, terms)).where(F.col("token").isin(sorted(set(terms))))
    return postings.join(blocks, ["token", "block"])


def search(versions: Versions, terms: list[str], k: int = 20) -> DataFrame:
    """The ``k`` best documents for a set of terms: key, score. All that have a term, if fewer."""
    spark = versions.spark
    if not terms or not versions.at:
        return spark.createDataFrame([], "key STRING, score DOUBLE")
    kept, _, _ = candidate_blocks(versions, terms, k)
    keys = _postings_of(versions, terms, kept).select("key").distinct()
    # what candidates have in skipped blocks counts too
    known = terms_of(versions, terms)
    postings = versions.read("postings", _buckets(versions, terms)).where(F.col("token").isin(sorted(set(terms))))
    scored = postings.join(keys, "key", "left_semi").join(F.broadcast(known), "token")
    score = F.round(F.sum(_worth(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean"))), 6)
    return scored.groupBy("key").agg(score.alias("score")).orderBy(F.desc("score"), "key").limit(k)


def search_symbols(versions: Versions, nodes: DataFrame, terms: list[str], k: int = 20) -> DataFrame:
    """Nodes whose indexed text has a term, by score: the search's keys joined to their rows."""
    found = search(versions, terms, k)
    return nodes.join(F.broadcast(found.withColumnRenamed("key", "id")), "id")  # k rows
