"""Quality rules with robust multivariate outliers (DataFrame functions only).

Every text gets counts, and from them a vector of transformed shares. For each language and source the minimum
covariance determinant is estimated by concentration steps from several starts: of the rows nearest by the estimate so
far, mean and covariance are computed, and so on; the smallest determinant holds. A text whose squared Mahalanobis
distance is over the limit is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, release, written

#: Names of the transformed statistics, and for each the least standard deviation. A share that hardly varies in a
#: group would otherwise make any other value an outlier.
STATS = {"x_length": 0.06, "x_symbols": 0.03, "x_lines": 0.12, "x_repeats": 0.12, "x_upper": 0.03}
#: Share of a group's rows that a concentration step keeps, and the number of steps.
KEEP, STEPS = 0.75, 3
#: Groups of fewer rows use the estimate of their language, and languages of fewer rows that of all rows.
LEAST_ROWS = 60
#: Squared distances over this are rejected: about the 1 - 1e-6 point of chi-square with 5 degrees of freedom.
LIMIT = 37.5
#: Levels that squared distances are counted by, so many to a power of two; quantiles come from these counts.
LEVELS = 32.0


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_upper of every whole text.

    Null text has no words. Windows are compared by 64-bit hashes; rows stay as many as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(c) for c in carry or []], text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    n = F.size("_words")
    # the hashes of the 3-word windows, with their places, in order of the hashes
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    out = base.select(
        "doc_id",
        *(carry or []),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        lines.alias("_lines"),
        hashes.alias("_hashes"),
    )
    out = out.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    # most texts have no window twice: only the others sort their windows
    pairs = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs)).drop("_hashes")
    last = F.size("_sorted") - 1
    again = F.filter("_sorted", lambda x, k: ((k > 0) & (F.get("_sorted", k - 1)["h"] == x["h"])) | ((k < last) & (F.get("_sorted", k + 1)["h"] == x["h"])))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return out.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")).drop("_sorted")


def _vector() -> list[Column]:
    """The transformed statistics, in the order of STATS; square roots spread the shares near 0."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    shares = [F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_upper") / chars)]
    return [s.alias(n) for s, n in zip(shares, STATS)]


def _quantile(df: DataFrame, groups: list[str], value: Column, share: float) -> DataFrame:
    """For each group the level under which ``share`` of its rows lie, from counts by level: exact counts, whatever the order of rows."""
    counts = df.groupBy(*groups, _level(value).alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    run, all_rows = Window.partitionBy(*groups).orderBy("_level"), Window.partitionBy(*groups)
    counts = counts.withColumn("_run", F.sum("_n").over(run)).withColumn("_total", F.sum("_n").over(all_rows))
    return counts.where(F.col("_run") >= F.col("_total") * share).groupBy(*groups).agg(F.min("_level").alias("_cut"))


def _level(value: Column) -> Column:
    return F.floor(F.log2(value + F.lit(1e-6)) * LEVELS)


def _moments(df: DataFrame, groups: list[str]) -> DataFrame:
    """Count, means and the covariance matrix (upper triangle c_i_j) of each group."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *_mean_and_covariance())


def _mean_and_covariance(of: Column | None = None, suffix: str = "") -> list[Column]:
    """Aggregates m_i and c_i_j, of all rows or of those for which ``of`` holds."""
    x = [F.col(n) if of is None else F.when(of, F.col(n)) for n in STATS]
    products = [F.covar_pop(a, x[j]).alias(f"c_{i}_{j}{suffix}") for i, a in enumerate(x) for j in range(i, len(x))]
    return [*[F.avg(v).alias(f"m_{i}{suffix}") for i, v in enumerate(x)], *products]


def _factor(moments: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the covariance with the least variances added, one column after another."""
    floors = list(STATS.values())
    for j in range(len(floors)):
        d = F.col(f"c_{j}_{j}") + floors[j] ** 2
        for k in range(j):
            d = d - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        moments = moments.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(d, F.lit(1e-9))))
        for i in range(j + 1, len(floors)):
            v = F.col(f"c_{j}_{i}")
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            moments = moments.withColumn(f"l_{i}_{j}", v / F.col(f"l_{j}_{j}"))
    return moments


def _distance(df: DataFrame) -> DataFrame:
    """Adds distance2, the squared Mahalanobis distance, and z_i, by forward substitution."""
    for i, n in enumerate(STATS):
        v = F.col(n) - F.col(f"m_{i}")
        for k in range(i):
            v = v - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        df = df.withColumn(f"z_{i}", v / F.col(f"l_{i}_{i}"))
    total = F.lit(0.0)
    for i in range(len(STATS)):
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return df.withColumn("distance2", total)


def _joined(df: DataFrame, table: DataFrame, groups: list[str], few: bool) -> DataFrame:
    """``df`` with the row of its group; nulls are a group."""
    renamed = table.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], *[c for c in table.columns if c not in groups])
    cond = F.lit(True)
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    return df.join(F.broadcast(renamed) if few else renamed, cond).drop(*[f"_k{i}" for i in range(len(groups))])


#: Up to this many groups their estimates are sent to every executor.
BROADCAST_GROUPS = 100_000


#: Names of an estimate's columns: means and the lower triangle of the factor.
FIGURES = [*[f"m_{i}" for i in range(len(STATS))], *[f"l_{i}_{j}" for i in range(len(STATS)) for j in range(i + 1)]]


def starts(stats: DataFrame, groups: list[str]) -> DataFrame:
    """Three first estimates of each group, numbered by ``start``, all in one pass over ``stats``.

    Medians with a diagonal of quartile ranges; means and covariance of all rows; those of a quarter of them, by hash.
    """
    names, size = list(STATS), range(len(STATS))
    quarter = F.pmod(F.xxhash64(*names), F.lit(4)) == 0
    quartiles = [F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, n in enumerate(names)]
    one = stats.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *quartiles, *_mean_and_covariance(None, "_a"), *_mean_and_covariance(quarter, "_b"))
    pairs = [(i, j) for i in size for j in range(i, len(STATS))]
    spread = lambda i: F.pow((F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / 1.349, 2)
    robust = [*[F.get(f"q_{i}", F.lit(1)).alias(f"m_{i}") for i in size], *[(spread(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs]]
    # a quarter without rows is all of them
    plain = lambda s: [F.coalesce(F.col(f"{n}{s}"), F.col(f"{n}_a")).alias(n) for n in (*[f"m_{i}" for i in size], *[f"c_{i}_{j}" for i, j in pairs])]
    made = [F.struct(F.lit(k).alias("start"), *columns) for k, columns in enumerate((robust, plain("_a"), plain("_b")))]
    return _factor(one.select(*groups, "rows", F.explode(F.array(*made)).alias("s")).select(*groups, "rows", "s.*"))


def mcd(stats: DataFrame, groups: list[str]) -> DataFrame:
    """For each group its rows, and means and Cholesky factor of the minimum covariance determinant.

    ``stats`` has the columns of STATS and is read twice a step. From each of the starts, a step keeps the share KEEP of
    the rows nearest by the estimate and estimates anew from them; after STEPS of these the estimate with the smallest
    determinant holds.
    """
    by = [*groups, "start"]
    estimate = written(starts(stats, groups).select(*by, F.col("rows").alias("all_rows"), *FIGURES), "mcd-step")
    few = estimate.count() <= BROADCAST_GROUPS
    for _ in range(STEPS):
        measured = _distance(_joined(stats, estimate, groups, few)).select(*by, "all_rows", *STATS, "distance2")
        cut = _quantile(measured, by, F.col("distance2"), KEEP)
        near = _joined(measured, cut, by, few).where(_level(F.col("distance2")) <= F.col("_cut"))
        estimate = written(_factor(_moments(near, [*by, "all_rows"])).select(*by, "all_rows", *FIGURES), "mcd-step")
    release(stats.sparkSession)
    determinant = sum((F.log(f"l_{i}_{i}") for i in range(len(STATS))), F.lit(0.0))
    best = estimate.groupBy(*groups).agg(F.min_by(F.struct(F.col("all_rows").alias("rows"), *FIGURES), F.struct(determinant, "start")).alias("e"))
    return best.select(*groups, "e.*")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Counts, base verdict, squared Mahalanobis distance and kept of every document.

    kept is false where the base rules fail (under 50 words, or over half of the words in repeated windows) and where
    the squared distance is over LIMIT. Estimates cover all documents of a group that pass the base rules.

    Null text has no words and fails; null language or source is a group. Repeated rows are judged alike. An empty
    table gives no rows. Columns named in ``carry`` are kept under a leading ``c_``.
    """
    carry = carry or []
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), *[F.col(c).alias(f"c_{c}") for c in carry])
    counts = text_counts(kept, "doc_id", "_t", ["_lang", "_source", *[f"c_{c}" for c in carry if c != text_col]])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(counts.select("*", failed.alias("base_failed"), *_vector()), "quality-stats")
    # every row stands for its language and source, for its language, and for all
    level = lambda n, lang, source: F.struct(F.lit(n).alias("level"), lang.cast("string").alias("_lang"), source.cast("string").alias("_source"))
    none = F.lit(None)
    levels = F.array(level(2, F.col("_lang"), F.col("_source")), level(1, F.col("_lang"), none), level(0, none, none))
    sound = stats.where("NOT base_failed").select(F.explode(levels).alias("g"), *STATS).select("g.*", *STATS)
    estimates = written(mcd(sound, ["level", "_lang", "_source"]), "mcd")
    few = estimates.count() <= BROADCAST_GROUPS
    # each group's own estimate, or that of the next larger group
    at = lambda level, suffix, *keys: estimates.where(F.col("level") == level).select(*[F.col(k).alias(f"{k}{suffix}") for k in keys], F.struct("rows", *FIGURES).alias(f"e{suffix}"))
    wide = at(2, "_2", "_lang", "_source").join(at(1, "_1", "_lang"), F.col("_lang_2").eqNullSafe(F.col("_lang_1")))
    wide = wide.crossJoin(F.broadcast(at(0, "_0")))  # one row
    enough = [F.when(F.col(f"e{x}.rows") >= LEAST_ROWS, F.col(f"e{x}")) for x in ("_2", "_1")]
    picked = wide.select(F.col("_lang_2").alias("_kl"), F.col("_source_2").alias("_ks"), F.coalesce(*enough, F.col("e_0")).alias("e")).select("_kl", "_ks", "e.*")
    measured = stats.join(F.broadcast(picked) if few else picked, F.col("_lang").eqNullSafe(F.col("_kl")) & F.col("_source").eqNullSafe(F.col("_ks")), "left")
    measured = _distance(measured)
    outlier = F.coalesce(F.col("distance2") > LIMIT, F.lit(False))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~outlier).alias("kept"), "distance2", *[f"c_{c}" for c in carry if c != text_col])
