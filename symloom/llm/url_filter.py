"""URL filtering by expansion and hash-prefix joins (DataFrame functions only).

A URL expands into every pair of a suffix of its host, cut at dots, and a prefix of its path, as long as some rule's
path. The first four bytes of each pair's SHA-256 are joined with those of the rules; the full digests then confirm a
match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that the join compares.
SHORT = 8
#: Salts of rows with equal URLs.
SALTS = 16
#: Up to this many rules are sent to every executor; more are joined by a shuffle.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from (verdict, host, path); a path begins with ``/`` or is empty."""
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (host and path of the rule that holds, or null) and verdict to ``pages``.

    A rule fits a URL on its host or a subdomain whose path starts with the rule's. The longest rule wins, counting
    host and path; of equally long ones that with the longer host, then ``block``. URLs that no rule fits, null
    ones among them, get ``default``. Rules with a null part are no rules; an empty rule host fits nothing. Rows keep
    their number, repeated ones too, and very long URLs are judged whole; an empty table gives no rows. Columns of the
    input named host, path, rule or verdict are replaced, all others are kept, whatever their names.
    """
    rules = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL AND host <> ''").dropDuplicates()
    n_rules, lengths = rules.agg(F.count(F.lit(1)), F.array_sort(F.collect_set(F.length("path")))).first()
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # the input's columns are one struct, so that none clashes with those made here
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    digest = _digest(F.col("host"), F.col("path"))
    table = rules.select(F.col("verdict").alias("_verdict"), F.concat("host", "path").alias("_rule"), F.length("host").alias("_len"), digest.alias("_full"))
    table = table.withColumn("_short", F.substring("_full", 1, SHORT))
    if n_rules <= BROADCAST_RULES:
        table = F.broadcast(table)
    # each different host and path once; host suffixes: the pieces between dots, joined from the k-th on
    urls = base.where("host <> ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = urls.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("_suffix"))
    # prefixes of those lengths that rules have; the number of lengths is bounded by the longest rule path
    heads = F.filter(F.array(*[F.lit(n) for n in lengths or [0]]), lambda n: n <= F.length("path"))
    expressions = suffixes.select("host", "path", "_suffix", F.explode(F.transform(heads, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("_prefix"))
    expressions = expressions.select("host", "path", _digest(F.col("_suffix"), F.col("_prefix")).alias("_digest"))
    hits = expressions.withColumn("_head", F.substring("_digest", 1, SHORT)).join(table, F.col("_head") == F.col("_short")).where("_digest = _full")
    order = F.struct(F.length("_rule").alias("a"), F.col("_len").alias("b"), (F.col("_verdict") == "block").cast("int").alias("c"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))
    won = hits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max(order).alias("_won"))
    # a URL may stand in very many rows: they are salted by their task
    won = won.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = base.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    out = salted.join(won, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")) & (F.col("_salt") == F.col("_s")), "left")
    return out.select("_page.*", "host", "path", F.col("_won.rule").alias("rule"), F.coalesce(F.col("_won.verdict"), F.lit(default)).alias("verdict"))
