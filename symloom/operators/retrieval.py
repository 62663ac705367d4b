"""Issue texts to tokens, anchors and frames, and files ranked for them by words, paths, commits and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import directory, name_parts, stem
from ..sources.graph import Graph
from .lookups import file_edges

#: Words that say nothing about code.
STOPWORDS = "the and for that with this from when not but are was has have should would could can will into than then they them its our you your all any use used using does did been being also only some such more most other over under about after before issue error bug fix".split()
#: Patterns of a stack frame by language; groups are file, line and function (0: none).
FRAMES = {
    "python": (r'File "([^"]+)", line (\d+)(?:, in (\w+))?', (1, 2, 3)),
    "javascript": (r"at (?:([\w.<>]+) )?\(?([^\s():]+\.[jt]sx?):(\d+):\d+\)?", (2, 3, 1)),
    "java": (r"at ([\w.$]+)\((\w+\.java):(\d+)\)", (2, 3, 1)),
    "go": (r"\s([\w/.-]+\.go):(\d+)", (1, 2, 0)),
    "rust": (r"at ([\w/.-]+\.rs):(\d+)", (1, 2, 0)),
    "ruby": (r"([\w/.-]+\.rb):(\d+):in [`'](\w+)", (1, 2, 3)),
}


def issue_tokens(text: Column, least: int = 3, most: int = 20) -> Column:
    """Distinct words of letters and digits, without stopwords, longest first and then by letters."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS)))
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.slice(F.array_sort(words, order), 1, most)


def query_terms(text: Column, anchors: Column, most: int = 80) -> Column:
    """Parts of the anchors (an array), then words of four letters and more, each once."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(F.concat(F.flatten(F.transform(anchors, name_parts)), words)), 1, most)


def issue_anchors(g: Graph, issues: DataFrame, key: str, text: Column) -> DataFrame:
    """Identifiers, paths and test names in texts: key, anchor, kind. Identifiers count where a node has the name."""
    identifiers = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]+(?:_[A-Za-z0-9]+)+|[a-z]+(?:[A-Z][a-z0-9]+)+|(?:[A-Z][a-z0-9]+){2,})\b"), F.lit(1))
    paths = F.regexp_extract_all(text, F.lit(r"\b((?:[\w.-]+/)+[\w.-]+\.\w{1,5})\b"), F.lit(1))
    tests = F.regexp_extract_all(text, F.lit(r"\b(test_\w+|Test[A-Z]\w+)\b"), F.lit(1))
    tagged = lambda found, kind: F.transform(F.array_distinct(found), lambda x: F.struct(x.alias("anchor"), F.lit(kind).alias("kind")))
    rows = issues.select(key, F.explode(F.concat(tagged(identifiers, "symbol"), tagged(paths, "path"), tagged(tests, "test"))).alias("a")).select(key, "a.anchor", "a.kind")
    names = g.nodes.select(F.col("name").alias("anchor")).distinct()
    return rows.where("kind = 'symbol'").join(names, "anchor", "left_semi").select(key, "anchor", "kind").unionByName(rows.where("kind <> 'symbol'"))


def weighted_tokens(issues: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, token, weight): the largest weight of the places that hold a token.

    Fixed values: frames 4, code blocks 3.5, back-ticked 3, error classes 3, snake or camel case 2, the first line 1.5, else 1.
    """
    spots = [
        (r'File "[^"]*?(\w+)\.py"', text, 4.0),
        (r"(?s)```(.*?)```", text, 3.5),
        (r"`([^`\n]+)`", text, 3.0),
        (r"\b(\w+(?:Error|Exception))\b", text, 3.0),
        (r"\b(\w+_\w+|[a-z]+[A-Z]\w*)\b", text, 2.0),
        (r"(.+)", F.substring_index(text, "\n", 1), 1.5),
        (r"(\w+)", text, 1.0),
    ]
    each = lambda p, t, w: F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda x: F.struct(x.alias("t"), F.lit(w).alias("w")))
    found = F.concat(*[each(*s) for s in spots])
    rows = issues.select(key, F.explode(found).alias("f")).select(key, F.explode(F.filter(F.split(F.lower(F.regexp_replace("f.t", r"[^A-Za-z0-9_]+", " ")), " "), lambda x: F.length(x) >= 3)).alias("token"), F.col("f.w").alias("weight"))
    return rows.where(~F.col("token").isin(*STOPWORDS)).groupBy(key, "token").agg(F.max("weight").alias("weight"))


def stack_frames(issues: DataFrame, key: str, text: Column) -> DataFrame:
    """Frames of stack traces in texts: key, language, place (from 0, in order of the text), file, line, function.

    Python prints the deepest frame last, the others first; ``depth`` counts from the deepest.
    """
    out = None
    for language, (pattern, groups) in FRAMES.items():
        parts = _frames(text, pattern, groups)
        rows = issues.select(key, F.lit(language).alias("language"), F.size(parts).alias("_n"), F.posexplode(parts).alias("place", "f"))
        depth = F.col("_n") - 1 - F.col("place") if language == "python" else F.col("place")
        rows = rows.select(key, "language", "place", depth.alias("depth"), "f.file", F.col("f.line").cast("int").alias("line"), "f.function")
        out = rows if out is None else out.unionByName(rows)
    return out


def _frames(text: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    part = lambda m: F.struct(*[(F.regexp_extract(m, pattern, i) if i else F.lit("")).alias(n) for n, i in zip(("file", "line", "function"), groups)])
    return F.transform(F.regexp_extract_all(text, F.lit("(?m)" + pattern), F.lit(0)), part)


def in_repository(g: Graph, frames: DataFrame) -> DataFrame:
    """The frames whose file ends with a path of the graph, with that path."""
    paths = g.nodes.select("file_path").distinct().withColumn("_base", F.substring_index("file_path", "/", -1))
    joined = frames.withColumn("_base", F.substring_index("file", "/", -1)).join(paths, "_base").where(F.col("file").endswith(F.col("file_path")))
    return joined.drop("_base")


def bm25_of_matches(docs: DataFrame, key: str, text: Column, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over the documents that hold a term: their number and mean length count, a length is a sixth of the characters."""
    terms = sorted(set(terms))
    hits = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lambda t: t.isin(terms))
    base = docs.select(key, F.greatest(F.lit(1), F.floor(F.length(text) / 6)).alias("n"), hits.alias("hits")).where(F.size("hits") > 0)
    totals = base.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    return _bm25(base.select(key, "n", F.explode("hits").alias("token")).groupBy(key, "n", "token").agg(F.count(F.lit(1)).alias("tf")), totals, key, k1, b)


def _bm25(tf: DataFrame, totals: DataFrame, key: str, k1: float, b: float, weights: dict[str, float] | None = None) -> DataFrame:
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(F.broadcast(df), "token").crossJoin(F.broadcast(totals))  # a row a term of the query, and one row
    weight = F.lit(1.0)
    for token, w in (weights or {}).items():
        weight = F.when(F.col("token") == token, w).otherwise(weight)
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return joined.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def bm25_of_paths(g: Graph, weights: dict[str, float], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of files whose document is the parts of their path, for weighted tokens."""
    files = g.nodes.select("file_path").distinct().withColumn("parts", F.filter(F.split(F.regexp_replace(F.lower("file_path"), "[^a-z0-9]+", " "), " "), lambda x: x != ""))
    totals = files.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("parts")).alias("mean"))
    tf = files.select("file_path", F.size("parts").alias("n"), F.explode("parts").alias("token")).where(F.col("token").isin(*weights)).groupBy("file_path", "n", "token").agg(F.count(F.lit(1)).alias("tf"))
    return _bm25(tf, totals, "file_path", k1, b, weights)


def bm25_in_files(g: Graph, weights: dict[str, float], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of functions within their file: document frequency and mean length are the file's; the file's best is 1."""
    docs = g.nodes.where("label IN ('Function', 'Method')").select("file_path", "id", F.split(F.regexp_replace(F.lower(F.concat_ws(" ", "name", "return_type")), "[^a-z0-9]+", " "), " ").alias("parts"))
    sizes = docs.groupBy("file_path").agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("parts")).alias("mean"))
    tf = docs.select("file_path", "id", F.size("parts").alias("n"), F.explode("parts").alias("token")).where(F.col("token").isin(*weights)).groupBy("file_path", "id", "n", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("file_path", "token").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(df, ["file_path", "token"]).join(sizes, "file_path")
    weight = F.lit(0.0)
    for token, w in weights.items():
        weight = F.when(F.col("token") == token, w).otherwise(weight)
    part = weight * F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = joined.groupBy("file_path", "id").agg(F.sum(part).alias("s"))
    return scored.select("file_path", "id", F.round(F.col("s") / F.max("s").over(Window.partitionBy("file_path")), 6).alias("score"))


def reranked_by_edges(g: Graph, scores: DataFrame, boost: float = 0.5, first: int = 10, most: int = 5) -> DataFrame:
    """The best files (file_path, score) again by score and by how many of the others refer to them; nothing if none does."""
    top = scores.orderBy(F.desc("score"), "file_path").limit(first)
    among = top.select("file_path")
    e = file_edges(g).join(among.withColumnRenamed("file_path", "target_file"), "target_file", "left_semi").join(among.withColumnRenamed("file_path", "source_file"), "source_file", "left_semi")
    into = e.groupBy(F.col("target_file").alias("file_path")).agg(F.count(F.lit(1)).alias("incoming"))
    joined = top.join(into, "file_path", "left").withColumn("incoming", F.coalesce("incoming", F.lit(0)))
    largest = F.max("incoming").over(Window.partitionBy())  # ten rows at most
    boosted = joined.withColumn("_m", largest).where("_m > 0").withColumn("score", F.round(F.col("score") * (1 + boost * F.col("incoming") / F.col("_m")), 6))
    return boosted.orderBy(F.desc("score"), "file_path").limit(most).select("file_path", "score", "incoming")


def augmented_query(g: Graph, issues: DataFrame, key: str, text: Column) -> DataFrame:
    """Words of texts that are stems of files or names of nodes, weighted by twice their normalised inverse frequency."""
    stems = g.nodes.select("file_path").distinct().groupBy(F.lower(stem(F.col("file_path"))).alias("token")).agg(F.count(F.lit(1)).alias("df"))
    names = g.nodes.groupBy(F.lower("name").alias("token")).agg(F.count(F.lit(1)).alias("df"))
    known = stems.withColumn("kind", F.lit("stem")).unionByName(names.withColumn("kind", F.lit("symbol")))
    total = g.nodes.agg(F.count(F.lit(1)).alias("total"))
    words = issues.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z_]{3,}"), F.lit(0)))).alias("token"))
    weight = 2 * F.log((1 + F.col("total")) / (1 + F.col("df"))) / F.log(1 + F.col("total"))
    joined = words.join(known, "token").crossJoin(F.broadcast(total))  # one row
    return joined.groupBy(key, "token").agg(F.round(F.max(weight), 6).alias("weight"))


def stem_scores(g: Graph, weights: DataFrame) -> DataFrame:
    """Files whose stem is a weighted token (token, weight), by the largest weight, the best 1."""
    files = g.nodes.select("file_path").distinct().withColumn("token", F.lower(stem(F.col("file_path"))))
    best = files.join(weights, "token").groupBy("file_path").agg(F.max("weight").alias("w"))
    peak = best.agg(F.max("w").alias("peak"))
    return best.crossJoin(F.broadcast(peak)).select("file_path", F.round(F.col("w") / F.col("peak"), 6).alias("score"))  # one row


def merged_anchors(semantic: DataFrame, symbol: DataFrame, lexical: DataFrame, least: float = 0.3) -> DataFrame:
    """Anchors by any of three signals (file_path, score): why, and whether trusted (a symbol, or two signals)."""
    s = semantic.where(F.col("score") >= least).select("file_path", F.lit(True).alias("s"))
    joined = s.join(symbol.select("file_path", F.lit(True).alias("y")), "file_path", "full").join(lexical.select("file_path", F.lit(True).alias("l")), "file_path", "full")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = F.when(has("s") & has("y"), "both").when(has("s"), "semantic").when(has("y"), "symbol").otherwise("")
    reason = F.when(has("l") & (why != ""), F.concat(why, F.lit("+lexical"))).when(has("l"), "lexical").otherwise(why)
    return joined.select("file_path", reason.alias("reason"), (has("y") | (has("s") & has("l"))).alias("trusted"))


def commit_memory(commits: DataFrame, files: DataFrame, terms: list[str], anchors: list[str], most_commits: int = 300, most: int = 20) -> DataFrame:
    """Files of commits (commit_id, ts, subject) whose subject or files meet the text's terms and anchors; later ones count more.

    ``files``: commit_id and file_path.
    """
    order = Window.orderBy(F.desc("ts"), F.desc("commit_id"))
    newest = commits.orderBy(F.desc("ts"), F.desc("commit_id")).limit(most_commits).withColumn("place", F.row_number().over(order) - 1)  # so many rows at most
    overlap = F.size(F.array_intersect(F.array_distinct(F.split(F.regexp_replace(F.lower("subject"), "[^a-z0-9]+", " "), " ")), F.array(*[F.lit(t) for t in terms])))
    touched = files.join(F.broadcast(newest.select("commit_id")), "commit_id", "left_semi")
    met = touched.where(F.col("file_path").isin(*anchors)).groupBy("commit_id").agg(F.countDistinct("file_path").alias("met"))
    scored = newest.join(met, "commit_id", "left").select("commit_id", ((overlap + 1.5 * F.coalesce("met", F.lit(0))) / F.log(F.col("place") + 3)).alias("s")).where("s > 0")
    return touched.join(scored, "commit_id").groupBy("file_path").agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), "file_path").limit(most)


def cochange_expansion(commits: DataFrame, seeds: list[str], last: int = 100, least: int = 2, most: int = 5) -> DataFrame:
    """Files of other folders that the last commits change with the seeds: count and coupling (share of the seeds' commits).

    ``commits``: commit_id, ts, file_path.
    """
    newest = commits.select("commit_id", "ts").distinct().orderBy(F.desc("ts"), F.desc("commit_id")).limit(last).select("commit_id")
    recent = commits.join(F.broadcast(newest), "commit_id", "left_semi")
    mine = recent.where(F.col("file_path").isin(*seeds)).select("commit_id").distinct()
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    folders = sorted({s.rsplit("/", 1)[0] for s in seeds})
    far = recent.join(mine, "commit_id", "left_semi").where(~directory(F.col("file_path")).isin(*folders)).groupBy("file_path").agg(F.countDistinct("commit_id").alias("n")).where(F.col("n") >= least)
    return far.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "file_path").limit(most).select("file_path", "n", F.round(F.col("n") / F.col("total"), 6).alias("coupling"))  # one row


def boosted(scores: DataFrame, recency: DataFrame, boost: float = 1.3) -> DataFrame:
    """Scores (file_path, score) raised by recency (file_path, weight)."""
    joined = scores.join(recency.select("file_path", "weight"), "file_path", "left")
    return joined.select("file_path", F.round(F.col("score") * (1 + F.least(F.coalesce("weight", F.lit(0.0)), F.lit(1.0)) * (boost - 1)), 6).alias("score"))


def provenance(files: DataFrame, symbol: DataFrame, frame: DataFrame, neighbour: DataFrame, recent: DataFrame) -> DataFrame:
    """Why files are candidates: the tags that hold, in their order of precedence."""
    out = files.select("file_path")
    tags = {"issue-symbol": symbol, "stack-frame": frame, "graph-neighbor": neighbour, "recent-edit": recent}
    for tag, found in tags.items():
        out = out.join(found.select("file_path").distinct().withColumn(tag, F.lit(tag)), "file_path", "left")
    test = F.when(F.col("file_path").startswith("tests/"), "test-of")
    return out.select("file_path", F.concat_ws(",", "`issue-symbol`", "`stack-frame`", "`graph-neighbor`", test, "`recent-edit`").alias("tags"))


def position_scores(ordered: DataFrame, key: str, order: list) -> DataFrame:
    """1 / place of keys that come in an order."""
    return ordered.select(key, F.round(1 / F.row_number().over(Window.orderBy(*order)), 6).alias("score"))  # a list of a query
