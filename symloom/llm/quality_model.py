"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document, for junk and for toxicity: shares of symbols, capitals, repeats
and function words, words and word heads mined from labelled documents, and the labels themselves where there are any.
Documents are counted by pattern of votes. Expectation-maximisation over these counts estimates how each labeller votes
in either class, and with that each pattern's posterior. The posteriors of a bounded sample train a hashed linear
scorer, and this scores every whole document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, written

#: Labelled documents that words are mined from, and documents that the scorer is trained on: at most, and about.
LABELLED, TRAINED = 10_000, 10_000
#: Bits of the feature space, and words whose features a task keeps, in each of two generations.
BITS, CACHE = 24, 60_000
#: Mined words: in so many toxic documents at least (as a number and as a share of them), which are so large a share of
#: all documents with the word.
MINED_DOCS, MINED_PART, MINED_SHARE = 3, 0.015, 0.85
HEAD = 5
ROUNDS = 60
#: Documents for each unit of the L1 penalty (1 at least), the L2 penalty and rate of the scorer's training (follow the
#: regularised leader), and its passes.
DOCS_L1, L2, RATE, EPOCHS = 2000, 0.5, 0.3, 4
#: Shares at which a text gets one more feature for that share.
LEVELS = (0.02, 0.04, 0.07, 0.1, 0.2, 0.3, 0.5, 0.7)
#: Frequent function words of the languages, and plain insults.
FUNCTION = frozenset(
    w.encode() for w in "the and of to in a is that it for with was on as are by this from be an de la le et les des un une que qui du pour dans sur par au est der die das und ist ein eine von zu mit den auf für nicht sich el los en y con se no por del las al".split()
)
INSULTS = frozenset(w.encode() for w in "idiot stupid moron scum loser trash worthless pathetic disgusting".split())
UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&|<>"


class Words:
    """Features of words, kept from text to text: slots of the word and its head, and marks of the lists it is in."""

    def __init__(self, lists: dict[str, frozenset[int]] | None = None):
        self.lists = lists or {}
        self.known: dict[bytes, tuple[int, int, int]] = {}
        self.old: dict[bytes, tuple[int, int, int]] = {}

    def of(self, word: bytes) -> tuple[int, int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.old, self.known = self.known, {}
            found = self.known[word] = self.old.get(word) or self._new(word)
        return found

    def _new(self, word: bytes) -> tuple[int, int, int]:
        bare = word.strip(b".,;:!?\"'()[]{}#*$%&|<>-")
        whole, head = slot(b"w" + bare), slot(b"h" + bare[:HEAD])
        marks = (bare in FUNCTION) | (bare in INSULTS) << 1
        for i, name in enumerate(("a", "b")):
            marks |= (whole in self.lists.get(name, ())) << (2 + i)
        return whole, head, marks | (head in self.lists.get("heads", ())) << 4


def slot(name: bytes) -> int:
    return zlib.crc32(name) >> (32 - BITS)


def shares(raw: bytes, words: list[bytes]) -> tuple[float, float, float, float]:
    """Shares of symbols and capitals among the bytes, of repeated 3-word windows, and of words equal to the one before."""
    size, n = max(len(raw), 1), len(words)
    symbols = 1 - len(raw.translate(None, SYMBOLS)) / size if raw else 0.0
    upper = 1 - len(raw.translate(None, UPPER)) / size if raw else 0.0
    repeats = 1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 3 else 0.0
    stutter = sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0
    return symbols, upper, repeats, stutter


QUALITY_LABELLERS, TOXIC_LABELLERS = 8, 5


def votes(raw: bytes, words: list[bytes], marks: list[int], figures: tuple[float, float, float, float]) -> tuple[list[int], list[int]]:
    """The heuristic votes for junk and for toxicity: 1 yes, 2 no, 0 abstains. The labels' own votes come last, later.

    Junk has kinds that exclude each other, so a labeller for one kind abstains on others; one votes for plain texts.
    """
    n = max(len(words), 1)
    symbols, upper, repeats, stutter = figures
    packed = bytes(marks)
    counts = [(v, packed.count(v)) for v in set(packed)]
    function = sum(c for v, c in counts if v & 1) / n
    shouts = raw.count(b"!") / n
    plain = symbols < 0.02 and upper < 0.1 and repeats < 0.2 and stutter < 0.1 and shouts < 0.05
    junk = [int(symbols > 0.04), int(upper > 0.35), int(repeats > 0.4), int(stutter > 0.25), int(shouts > 0.3), int(n >= 20 and function < 0.01), 2 * plain]
    hits = [sum(c for v, c in counts if v >> i & 1) for i in range(1, 5)]
    toxic = [int(hits[0] >= 2), *(1 if h >= 2 else 2 if h == 0 else 0 for h in hits[1:])]
    return junk, toxic


def features(figures: tuple[float, float, float, float], seen: list[tuple[int, int, int]]) -> list[int]:
    """Distinct slots of a text: words, word heads, levels that the shares reach, and hits of the lists (one, two)."""
    out = {slot(b"%d:%d" % (i, k)) for i, x in enumerate(figures) for k, least in enumerate(LEVELS) if x >= least}
    hits = [0] * 5
    for whole, head, marks in seen:
        out.add(whole)
        out.add(head)
        if marks > 1:
            for i in range(1, 5):
                hits[i] += marks >> i & 1
    out.update(slot(b"m%d:%d" % (i, k)) for i in range(1, 5) for k in (1, 2) if hits[i] >= k)
    return list(out)


def pattern(of: list[int]) -> int:
    code = 0
    for v in reversed(of):
        code = 3 * code + v
    return code


def digits(code: int, n: int) -> list[int]:
    return [code // 3**i % 3 for i in range(n)]


def fit_labellers(counts: dict[int, int], n: int, prior: float) -> dict[int, float]:
    """Posterior of the class 1 for each pattern of ``n`` votes, by expectation-maximisation over the patterns' counts.

    Votes are independent given the class; each labeller has its own shares of yes, no and abstaining in each class.
    The start is the majority of the votes.
    """
    if not counts:
        return {}
    codes = sorted(counts)
    votes_ = np.array([digits(c, n) for c in codes])
    weight = np.array([counts[c] for c in codes], float)
    yes, no = (votes_ == 1).sum(axis=1), (votes_ == 2).sum(axis=1)
    post = np.clip((yes + 2 * prior) / (yes + no + 2), 0.02, 0.98)
    one_hot = np.stack([votes_ == v for v in range(3)], axis=2).astype(float)
    for _ in range(ROUNDS):
        tables = []
        for p in (post, 1 - post):
            w = weight * p
            tables.append((np.einsum("i,ijk->jk", w, one_hot) + 0.5) / (w.sum() + 1.5))
        share = np.clip((weight * post).sum() / weight.sum(), 1e-4, 0.9)
        score = np.log(share) - np.log(1 - share) + np.einsum("ijk,jk->i", one_hot, np.log(tables[0]) - np.log(tables[1]))
        post = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    return dict(zip(codes, post.tolist()))


class Rows:
    """Lists of slots in one flat array, as Arrow has them."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
        self.flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        self.lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
        ends = np.cumsum(self.lengths)
        self.starts, self.ends = ends - self.lengths, ends

    def __len__(self) -> int:
        return len(self.lengths)


def train(rows: Rows, order_of: np.ndarray, targets: np.ndarray) -> tuple[dict[int, float], float]:
    """Sparse weights and bias of a logistic scorer over slots, by follow-the-regularised-leader with an L1 penalty.

    ``order_of``: an order of the rows that doesn't depend on how they came.
    """
    if not len(rows):
        return {}, -4.0
    slots, starts, ends = np.unique(rows.flat), rows.starts, rows.ends
    place = np.concatenate([np.searchsorted(slots, part).astype(np.int32) for part in np.array_split(rows.flat, len(rows.flat) // (1 << 20) + 1)])
    z, n = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    bias = len(slots)
    order = np.random.default_rng(3)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        penalty = np.where(at == bias, 0.0, max(1.0, len(rows) / DOCS_L1))
        return np.where(np.abs(zs) <= penalty, 0.0, -(zs - np.sign(zs) * penalty) / ((1 + np.sqrt(n[at])) / RATE + L2))

    for _ in range(EPOCHS):
        for i in order_of[order.permutation(len(rows))]:
            at = np.append(place[starts[i] : ends[i]], bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - targets[i]
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(len(slots) + 1))
    return {int(k): float(v) for k, v in zip(slots, w[:-1]) if v}, float(w[-1])


def mine(sample: DataFrame) -> dict[str, frozenset[int]]:
    """Slots of words (from either half of the labelled documents) and of word heads that tell toxic documents.

    ``sample``: half, toxic (0 or 1), words and heads of a document each. Only slots that tell are collected.
    """

    def tells(docs: DataFrame, column: str) -> frozenset[int]:
        least = max(MINED_DOCS, MINED_PART * (docs.agg(F.sum("toxic")).first()[0] or 0))
        counts = docs.select("toxic", F.explode(column).alias("slot")).groupBy("slot").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("docs"))
        found = counts.where((F.col("hits") >= least) & (F.col("hits") >= MINED_SHARE * F.col("docs")))
        return frozenset(r["slot"] for r in found.select("slot").collect())

    return {"a": tells(sample.where("half = 1"), "words"), "b": tells(sample.where("half = 0"), "words"), "heads": tells(sample, "heads")}


def _slices(parts: Iterator[pa.Array]) -> Iterator[list[bytes]]:
    """The texts of batches, batch by batch, which small_batches keeps small."""
    for texts in parts:
        yield [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def bounded(df: DataFrame, by: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the smallest hash ``by``; of rows with equal hashes one."""
    keyed = df.withColumn("_by", by)
    few = keyed.select("_by").distinct().orderBy("_by").limit(rows)
    return keyed.join(F.broadcast(few), "_by", "left_semi").dropDuplicates(["_by"]).drop("_by")


def classify(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", junk_limit: float = 0.8, toxic_limit: float = 0.5) -> DataFrame:
    """``docs`` with junk_score, toxic_score (probabilities) and kept, false where either is over its limit.

    ``labels`` has id, quality (0 is junk) and toxic (1 is toxic); of repeated ids the worst counts, null values
    abstain. Without labels the heuristics stand alone. A null or empty text gets junk_score 1. Repeated rows are judged
    alike and enter a sample once, an empty table gives no rows. Input columns named like the added ones are replaced;
    all other columns stay in the JVM, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ["junk_score", "toxic_score", "kept"]
    docs = docs.drop(*added)
    text = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    if labels is None:
        labels = spark.createDataFrame([], f"{id_col} long, quality int, toxic int")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = written(known, "quality-labels")

    # words and heads of labelled documents; the sample is bounded by LABELLED ids
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)

    @F.arrow_udf("struct<words: array<int>, heads: array<int>>")
    def list_slots(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for texts in _slices(parts):
            seen = [[words.of(w) for w in set(t.lower().split())] for t in texts]
            yield pa.StructArray.from_arrays([pa.array([list({x[i] for x in s}) for s in seen], pa.list_(pa.int32())) for i in (0, 1)], ["words", "heads"])

    mined_from = text.join(F.broadcast(chosen), F.col("id") == F.col("_id")).where("toxic IS NOT NULL")
    mined_from = bounded(mined_from.select("id", "text", "toxic"), F.xxhash64("id", "text"), LABELLED)
    sample = mined_from.select("id", "toxic", list_slots("text").alias("s")).select("id", "toxic", "s.words", "s.heads")
    sample = sample.select((F.crc32(F.col("id").cast("binary")) % 2).alias("half"), (F.col("toxic") > 0).cast("int").alias("toxic"), "words", "heads")
    lists = mine(written(sample, "quality-slots"))

    def judge(raw: bytes, words: Words) -> tuple[list[bytes], tuple, int, int]:
        """The text's words, its shares, and its patterns of votes for junk and for toxicity."""
        low = raw.lower().split()
        figures = shares(raw, low)
        junk, toxic = votes(raw, low, [words.of(w)[2] for w in low], figures)
        return low, figures, pattern(junk), pattern(toxic)

    @F.arrow_udf("struct<junk: int, toxic: int>")
    def vote(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(lists)
        for texts in _slices(parts):
            found = [judge(raw, words)[2:] for raw in texts]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)], ["junk", "toxic"])

    @F.arrow_udf("struct<junk: int, toxic: int, features: array<int>>")
    def vote_with_features(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(lists)
        for texts in _slices(parts):
            found = [(junk, toxic, features(figures, [words.of(w) for w in set(low)])) for low, figures, junk, toxic in (judge(raw, words) for raw in texts)]
            kinds = pa.int32(), pa.int32(), pa.list_(pa.int32())
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["junk", "toxic", "features"])

    def with_labels(voted: DataFrame) -> DataFrame:
        """Adds the labels' votes as the last digit of the patterns."""
        known_ = known.select("_id", F.col("quality").alias("_q"), F.col("toxic").alias("_t"))
        both = voted.join(known_, F.col("id") == F.col("_id"), "left")
        junk = F.when(F.col("_q") == 0, 1).when(F.col("_q") > 0, 2).otherwise(0) * 3 ** (QUALITY_LABELLERS - 1) + F.col("junk")
        toxic = F.when(F.col("_t") > 0, 1).when(F.col("_t") == 0, 2).otherwise(0) * 3 ** (TOXIC_LABELLERS - 1) + F.col("toxic")
        return both.select(*[c for c in voted.columns if c not in ("junk", "toxic")], junk.alias("junk"), toxic.alias("toxic"))

    voted = written(text.select("id", vote("text").alias("v")).select("id", "v.junk", "v.toxic"), "quality-votes")
    counts = with_labels(voted).groupBy("junk", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # 3^7 * 3^5 rows at most
    rows_of = lambda name: {k: sum(r["n"] for r in counts if r[name] == k) for k in {r[name] for r in counts}}
    post_junk = fit_labellers(rows_of("junk"), QUALITY_LABELLERS, 0.1)
    post_toxic = fit_labellers(rows_of("toxic"), TOXIC_LABELLERS, 0.1)
    total = sum(r["n"] for r in counts)

    # the scorer's sample: TRAINED different documents at most, by a hash of id and text
    by = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 60))
    part = bounded(text.where(by < F.lit(min(1 << 60, (TRAINED << 60) // max(total, 1) * 5 // 4))), by, TRAINED)
    trained = with_labels(part.select("id", vote_with_features("text").alias("v")).select("id", "v.*")).toArrow()
    rows = Rows(trained["features"])
    order = np.argsort([zlib.crc32((x or "").encode()) for x in trained["id"].to_pylist()], kind="stable")
    heads = []
    for name, post in (("junk", post_junk), ("toxic", post_toxic)):
        targets = np.array([post.get(x, 0.5) for x in trained[name].to_pylist()])
        heads.append(train(rows, order, targets))
    del trained, rows
    release(spark)
    model = spark.sparkContext.broadcast(heads)

    @F.arrow_udf("struct<junk_score: double, toxic_score: double>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (junk_w, junk_b), (toxic_w, toxic_b) = model.value
        words = Words(lists)
        for texts in _slices(parts):
            found = []
            for raw in texts:
                low = raw.lower().split()
                slots = features(shares(raw, low), [words.of(w) for w in set(low)])
                a = junk_b + sum(junk_w.get(s, 0.0) for s in slots)
                b = toxic_b + sum(toxic_w.get(s, 0.0) for s in slots)
                found.append((_chance(a) if low else 1.0, _chance(b) if low else 0.0))
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in (0, 1)], ["junk_score", "toxic_score"])

    # the text alone goes to Python, the scores alone come back
    judged = docs.withColumn("junk_score", score(F.col(text_col)))
    judged = judged.withColumn("toxic_score", F.col("junk_score.toxic_score")).withColumn("junk_score", F.col("junk_score.junk_score"))
    return judged.withColumn("kept", (F.col("junk_score") < junk_limit) & (F.col("toxic_score") < toxic_limit))


def _chance(x: float) -> float:
    return float(1 / (1 + np.exp(-max(min(x, 35), -35))))
