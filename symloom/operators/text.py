"""Lexical and vector retrieval, tokens, anchors and fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import cosine, name_parts, stem, words
from ..sources.graph import Graph


def token_counts(docs: DataFrame, key: str, text: Column, pattern: str = "[a-z]{3,}") -> DataFrame:
    """(key, token, tf) of lower-case tokens."""
    tokens = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("token"))
    return tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: Column, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of documents for the query's distinct words; number, mean length and document frequency over all documents.

    Only the query's words are counted; a length is the number of tokens.
    """
    query = sorted(set(query))
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    base = docs.select(key, F.size(tokens).alias("n"), F.filter(tokens, lambda t: t.isin(query)).alias("hits"))
    totals = base.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    tf = base.select(key, "n", F.explode("hits").alias("token")).groupBy(key, "n", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(F.broadcast(df), "token").crossJoin(F.broadcast(totals))  # a row a word of the query, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return joined.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def idf_weights(docs: DataFrame, key: str, text: Column, most: int = 100) -> DataFrame:
    """The words in most documents with their inverse document frequency."""
    tokens = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))).alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "token").limit(most)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def path_segments(g: Graph) -> DataFrame:
    """Distinct files by the parts of their paths."""
    files = g.nodes.select("file_path").distinct()
    return files.select("file_path", F.explode(F.array_distinct(name_parts(F.col("file_path")))).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("files"))


def name_components(g: Graph) -> DataFrame:
    """Parts of names with the number of nodes that have them."""
    return g.nodes.select("id", F.explode(F.array_distinct(name_parts(F.col("name")))).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))


def symbol_anchors(g: Graph, text: list[str], most: int = 10) -> DataFrame:
    """Files by the number of their distinct names all of whose parts are in the text."""
    known = F.array(*[F.lit(t) for t in sorted(set(text))])
    names = g.nodes.select("file_path", "name").distinct()
    return names.where(F.size(F.array_except(name_parts(F.col("name")), known)) == 0).groupBy("file_path").agg(F.count(F.lit(1)).alias("names")).orderBy(F.desc("names"), "file_path").limit(most)


def stem_matches(g: Graph) -> DataFrame:
    """Tests' stems against sources' stems: 1 where equal, .7 where one is in the other."""
    files = g.nodes.select("file_path", "is_test").distinct().withColumn("stem", stem(F.col("file_path")))
    t = files.where("is_test").groupBy("stem").agg(F.count(F.lit(1)).alias("tests"))
    s = files.where("NOT is_test").groupBy(F.col("stem").alias("source_stem")).agg(F.count(F.lit(1)).alias("sources"))
    return t.join(s, F.col("stem") == F.col("source_stem")).select("stem", (F.col("tests") * F.col("sources")).alias("pairs"))


def code_grep(docs: DataFrame, needle: str, per_doc: int = 3) -> DataFrame:
    """Lines that hold a text, the first few of each document, numbered from 1."""
    lines = docs.where(F.contains("text", F.lit(needle))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    hits = lines.where(F.contains("line", F.lit(needle)))
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("no"))).where(F.col("_k") <= per_doc).select("doc_id", (F.col("no") + 1).alias("line_no"), F.length("line").alias("n_chars"))


def task_words(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Distinct words of each text, longest first, twelve at most."""
    ordered = F.array_sort(words(text, 4), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return docs.select(key, F.array_join(F.slice(ordered, 1, 12), " ").alias("query"))


def cosine_topk(vectors: DataFrame, query_id: int, most: int = 20) -> DataFrame:
    """The vectors nearest to one of them."""
    q = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q"))
    scored = vectors.crossJoin(F.broadcast(q)).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("s"))  # one row
    return scored.orderBy(F.desc("s"), "vec_id").limit(most).select("vec_id", F.round("s", 6).alias("score"))


def semantic_max(vectors: DataFrame, queries: list[int], most: int = 20) -> DataFrame:
    """Vectors by their largest cosine with any of a few."""
    q = vectors.where(F.col("vec_id").isin(queries)).select(F.col("embedding").alias("q"))
    scored = vectors.crossJoin(F.broadcast(q)).groupBy("vec_id").agg(F.max(cosine(F.col("embedding"), F.col("q"))).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(most).select("vec_id", F.round("s", 6).alias("score"))


def ranked(df: DataFrame, signal: str, score: str, key: str, most: int = 100) -> DataFrame:
    """The top rows of a signal with their ranks."""
    top = df.orderBy(F.desc(score), key).limit(most)
    return top.select(F.col(key).alias("key"), F.lit(signal).alias("signal"), F.row_number().over(Window.orderBy(F.desc(score), key)).alias("rank"))


def rrf(signals: DataFrame, weights: dict[str, float] | None = None, k: int = 60, most: int = 50) -> DataFrame:
    """Reciprocal rank fusion of (key, signal, rank)."""
    w = F.lit(1.0)
    for name, weight in (weights or {}).items():
        w = F.when(F.col("signal") == name, weight).otherwise(w)
    fused = signals.groupBy("key").agg(F.sum(w / (k + F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("signals"))
    return fused.orderBy(F.desc("s"), "key").limit(most).select("key", F.round("s", 6).alias("score"), "signals")


def agreement(signals: DataFrame) -> DataFrame:
    """How many signals stand behind each key, and its best rank."""
    return signals.groupBy("key").agg(F.countDistinct("signal").alias("signals"), F.min("rank").alias("best"))
