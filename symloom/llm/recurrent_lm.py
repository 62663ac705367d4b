"""Scoring of documents by a gated recurrent language model with a class-factored softmax.

Words fall into classes: the most frequent words and the end of a text are classes of their own, the others share
classes by their last letters. The recurrent network, in numpy, reads words (frequent ones as such, others by bucket) and
predicts from its state the class of the next word, and in a shared class which of the class's most frequent words it is,
or another; a word that isn't listed then has its share of the class's other training tokens. Counts cover all training
documents. The network learns from all of them too: every partition trains a copy by truncated backpropagation from the
same start, and copies are averaged by their tokens, in two rounds. Windows only cut gradients; the state is carried to
the end of a text.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Frequent words that are classes of their own (with the end), classes by last letters, and by length for the rest.
OWN, ENDINGS, REST = 40, 20, 4
CLASSES = OWN + ENDINGS + REST
#: Entries of a shared class: its most frequent words, and one for all others.
INNER = 32
#: Buckets that stand for all other words as inputs, and the input that begins a text.
BUCKETS = 512
START = OWN + BUCKETS
#: Units, steps of a window (and at most, where few texts are left), and texts side by side.
UNITS, STEPS, LONGEST, LANES = 16, 16, 256, 256
#: Words whose counts every task has; the counts of the others are joined.
LISTED = 150_000
#: Training documents of the first round: one in so many.
FIRST = 8
RATE = 0.01
#: Distinct words that a task counts before it passes them on, tokens that it works on at once, words it keeps.
COUNTED, BLOCK, CACHE = 200_000, 800_000, 150_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


class Network:
    """The recurrent network. Inputs are words: frequent ones of their own, others by bucket; START begins a text.

    ``out`` and ``bias`` give the classes, ``inner`` and ``inner_bias`` for each shared class its listed words, of which
    entry 0 stands for all other words of the class.
    """

    def __init__(self, parameters: np.ndarray | None = None, shares: np.ndarray | None = None, inner_shares: np.ndarray | None = None):
        c, h, shared = CLASSES, UNITS, CLASSES - OWN
        shapes = [("inputs", (START + 1, 3 * h)), ("gates", (h, 2 * h)), ("candidate", (h, h)), ("out", (h, c)), ("bias", (c,)), ("inner", (shared, h, INNER)), ("inner_bias", (shared, INNER))]
        self.flat = np.zeros(sum(int(np.prod(s)) for _, s in shapes), np.float32)
        at = 0
        for name, shape in shapes:
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n
        if parameters is not None:
            self.flat[:] = parameters
        else:
            self.flat[:] = np.random.default_rng(11).normal(0, 0.15, len(self.flat))
            self.bias[:] = np.log(shares)
            self.inner_bias[:] = np.log(inner_shares)

    def window(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States after each step of ``x`` (steps by lanes) from ``state``; a start input clears the state before it."""
        h, u = state, UNITS
        steps, lanes = x.shape
        states, kept = np.empty((steps, lanes, u), np.float32), []
        goes_on = (x != START)[:, :, None]
        for t in range(steps):
            g = self.inputs[x[t]]
            h = h * goes_on[t]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * u] + h @ self.gates)))
            z, r = zr[:, :u], zr[:, u:]
            rh = r * h
            c = np.tanh(g[:, 2 * u :] + rh @ self.candidate)
            new = h + z * (c - h)
            kept.append((h, z, r, rh, c))
            states[t] = h = new
        return states, kept

    def log_shares(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the classes, their exponentials, and the sums of these."""
        y = states.reshape(-1, UNITS) @ self.out
        y += self.bias
        np.minimum(y, 80, out=y)  # keeps the exponential finite; trained values are far below
        e = np.exp(y)
        return y, e, e @ np.ones(CLASSES, np.float32)

    def within(self, states: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shared class among ``classes``: its number, the rows, and as :meth:`log_shares` the scores of its words."""
        order = np.argsort(classes, kind="stable")
        ends = np.searchsorted(classes[order], np.arange(OWN, CLASSES + 1))
        for k in range(CLASSES - OWN):
            rows = order[ends[k] : ends[k + 1]]
            if len(rows):
                y = states[rows] @ self.inner[k] + self.inner_bias[k]
                np.minimum(y, 80, out=y)
                e = np.exp(y)
                yield k, rows, y, e, e.sum(axis=1)

    def learn(self, x: np.ndarray, target: np.ndarray, inner: np.ndarray, live: np.ndarray, state: np.ndarray, g: Network) -> tuple[np.ndarray, float]:
        """Puts the gradient of a window's mean loss into ``g``; the last state and the summed loss.

        ``target`` has classes (-1 where not ``live``), ``inner`` the entries in shared classes.
        """
        u = UNITS
        states, kept = self.window(x, state)
        y, e, total = self.log_shares(states)
        n = max(int(live.sum()), 1)
        flat_target, flat_inner, flat_live = np.where(live, target, 0).ravel(), inner.ravel(), live.ravel().astype(np.float32)
        rows = np.arange(len(y))
        loss = float(((np.log(total) - y[rows, flat_target]) * flat_live).sum())
        d = e / total[:, None]
        d[rows, flat_target] -= 1
        d *= (flat_live / n)[:, None]
        g.flat[:] = 0
        flat_states = states.reshape(-1, u)
        g.out[:] = flat_states.T @ d
        g.bias[:] = d.sum(axis=0)
        dh_out = d @ self.out.T
        for k, of, y, e, total in self.within(flat_states, np.where(live, target, -1).ravel()):
            at = flat_inner[of]
            loss += float((np.log(total) - y[np.arange(len(of)), at]).sum())
            d = e / total[:, None]
            d[np.arange(len(of)), at] -= 1
            d /= n
            g.inner[k] = flat_states[of].T @ d
            g.inner_bias[k] = d.sum(axis=0)
            dh_out[of] += d @ self.inner[k].T
        dh_out = dh_out.reshape(states.shape)
        dh, inputs = np.zeros_like(state), np.empty((*x.shape, 3 * u), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, rh, c = kept[t]
            dh = dh + dh_out[t]
            dc = dh * z * (1 - c * c)
            drh = dc @ self.candidate.T
            dzr = np.concatenate([dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
            g.candidate += rh.T @ dc
            g.gates += h.T @ dzr
            inputs[t, :, : 2 * u], inputs[t, :, 2 * u :] = dzr, dc
            dh = (dh * (1 - z) + drh * r + dzr @ self.gates.T) * (x[t] != START)[:, None]
        flat_x, rows_in = x.ravel(), inputs.reshape(-1, 3 * u)
        order = np.argsort(flat_x, kind="stable")
        sorted_x = flat_x[order]
        first = np.concatenate([[0], np.nonzero(sorted_x[1:] != sorted_x[:-1])[0] + 1])
        g.inputs[sorted_x[first]] = np.add.reduceat(rows_in[order], first, axis=0)
        return states[-1], loss


class Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        norm = float(np.sqrt((grad * grad).sum()))
        if not math.isfinite(norm):
            return
        grad = grad * min(1.0, 1.0 / (norm + 1e-9))
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        flat -= RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


#: What a word is to the network: its input, its class, and its entry in a shared class.
WORD_OF = np.dtype([("x", "<u2"), ("k", "u1"), ("j", "u1")])


def lanes(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts (arrays of WORD_OF, ends included) side by side: inputs, classes, entries and text numbers (-1: nothing), by
    step and lane. Lanes descend in length, so that what is left at a step is the first lanes."""
    n = min(LANES, len(texts))
    load, rows = [0] * n, [[] for _ in range(n)]
    heap = [(0, i) for i in range(n)]
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        least, i = heapq.heappop(heap)
        rows[i].append(k)
        load[i] = least + len(texts[k])
        heapq.heappush(heap, (load[i], i))
    order = sorted(range(n), key=lambda i: -load[i])
    steps = max(load)
    x, y, j, of = np.zeros((steps, n), np.int16), np.zeros((steps, n), np.int16), np.zeros((steps, n), np.int16), np.full((steps, n), -1, np.int32)
    for lane, i in enumerate(order):
        at = 0
        for k in rows[i]:
            t = texts[k]
            to = slice(at, at + len(t))
            y[to, lane], j[to, lane], of[to, lane] = t["k"], t["j"], k
            x[at, lane] = START
            x[at + 1 : at + len(t), lane] = t["x"][:-1]
            at += len(t)
    return x, y, j, of


def windows(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """First and last step of each window and the lanes that it has: STEPS steps of all lanes, more where few lanes are left."""
    at, lanes_left = 0, (of >= 0).sum(axis=1)
    while at < len(of):
        n = int(lanes_left[at])
        upto = min(len(of), at + min(LONGEST, STEPS * max(1, LANES // n)))
        yield at, upto, n
        at = upto


def score_words(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """The natural logarithm of each text's probability as a sequence of classes and entries in shared classes."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    x, y, j, of = lanes(texts)
    state = np.zeros((x.shape[1], UNITS), np.float32)
    for at, upto, n in windows(of):
        states, _ = net.window(x[at:upto, :n], state[:n])
        state = states[-1]
        logits, _e, total = net.log_shares(states)
        target, entry, texts_of = (a[at:upto, :n].ravel() for a in (y, j, of))
        value = logits[np.arange(len(logits)), target] - np.log(total)
        for _k, rows, logits, _e, total in net.within(states.reshape(-1, UNITS), np.where(texts_of >= 0, target, -1)):
            value[rows] += logits[np.arange(len(rows)), entry[rows]] - np.log(total)
        ok = texts_of >= 0
        out += np.bincount(texts_of[ok], value[ok], len(texts))
    return out


def train_words(net: Network, adam: Adam, texts: list[np.ndarray]) -> float:
    """One pass over the texts; the summed loss."""
    x, y, j, of = lanes(texts)
    state, grad, loss = np.zeros((x.shape[1], UNITS), np.float32), Network(np.zeros_like(net.flat)), 0.0
    for at, upto, n in windows(of):
        live = of[at:upto, :n] >= 0
        state, more = net.learn(x[at:upto, :n], y[at:upto, :n], j[at:upto, :n], live, state[:n], grad)
        adam.step(net.flat, grad.flat)
        loss += more
    return loss


@dataclass
class Vocabulary:
    """What every task knows of the words: bounded by LISTED words and CLASSES classes of INNER entries."""

    own: dict[bytes, int]
    endings: dict[str, int]
    entries: dict[bytes, int]
    counts: dict[bytes, int]
    rest_total: list[int]
    class_once: list[int]
    tokens: int
    distinct: int

    def class_of(self, word: bytes) -> int:
        found = self.own.get(word)
        if found is None:
            s = word.decode("utf-8", "replace")
            found = self.endings.get(s[-2:])
            if found is None:
                found = OWN + ENDINGS + len(s) % REST
        return found

    def of(self, word: bytes) -> tuple[int, int, int]:
        """The word as WORD_OF has it."""
        k = self.class_of(word)
        return (k if k < OWN else OWN + zlib.crc32(word) % BUCKETS), k, self.entries.get(word, 0)

    def unknown(self, k: int) -> float:
        """The share of a class's other words that have no count, by the words seen once."""
        return (self.class_once[k] + 0.5) / (self.rest_total[k] + self.class_once[k] + 1.0)

    def known_log10(self, k: int) -> float:
        """What an other word of a class adds to the logarithm of its share, its count left out."""
        if k < OWN:
            return 0.0
        return math.log10(1 - self.unknown(k)) - math.log10(max(self.rest_total[k], 1))

    def base_scale(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))


def _tokens(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Values of the columns and words of texts, in blocks of some tokens."""
    values, texts, total = [], [], 0
    for batch in batches:
        others = [batch.column(c).to_pylist() for c in columns]
        for i, text in enumerate(batch.column("text")):
            words = (text.as_py() or b"").lower().split()
            values.append([o[i] for o in others])
            texts.append(words)
            total += len(words) + 1
            if total >= BLOCK:
                yield values, texts
                values, texts, total = [], [], 0
    if texts:
        yield values, texts


@dataclass
class Model:
    """A fitted model: the words, the network's parameters, and the counts of all words as a table."""

    words: Vocabulary
    parameters: np.ndarray
    counts: DataFrame


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from all documents that aren't held out. See :func:`score_documents`."""
    spark = docs.sparkSession
    training = _base(docs, id_col, text_col).where("NOT held_out")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                found.update((text.as_py() or b"").lower().split())
                found[b""] += 1  # the end
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
        if found:
            yield out()

    counts = written(training.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    listed = counts.orderBy(F.desc("n"), "word").limit(LISTED).toArrow()
    words, numbers = [w.encode() for w in listed["word"].to_pylist()], listed["n"].to_pylist()
    own = {w: i for i, w in enumerate([b"", *[w for w in words[:OWN] if w][: OWN - 1]])}
    own_words = spark.createDataFrame([(w.decode(), i) for w, i in own.items()], "own_word string, own_class int")
    rest = counts.join(F.broadcast(own_words), F.col("word") == F.col("own_word"), "left")
    ending = F.expr("right(word, 2)")
    tops = rest.where("own_class IS NULL").groupBy(ending.alias("e")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "e").limit(ENDINGS).collect()
    endings = {r["e"]: OWN + i for i, r in enumerate(tops)}
    class_of = F.lit(OWN + ENDINGS) + F.length("word") % REST
    for e, k in endings.items():
        class_of = F.when(ending == e, k).otherwise(class_of)
    sizes = rest.groupBy(F.coalesce("own_class", class_of).alias("k")).agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("int")).alias("once")).collect()
    total, once = [0] * CLASSES, [0] * CLASSES
    for r in sizes:
        total[r["k"]], once[r["k"]] = r["n"], r["once"]
    table = Vocabulary(own, endings, {}, dict(zip(words, numbers)), list(total), once, tokens, distinct)
    # the most frequent words of each shared class are its entries
    filled, weights = [1] * CLASSES, np.full((CLASSES - OWN, INNER), 0.5)
    for w, n in zip(words, numbers):
        k = table.class_of(w)
        if k >= OWN and filled[k] < INNER:
            table.entries[w], weights[k - OWN, filled[k]] = filled[k], n + 0.5
            filled[k], table.rest_total[k], once[k] = filled[k] + 1, table.rest_total[k] - n, once[k] - (n == 1)
    weights[:, 0] += table.rest_total[OWN:]
    share = (np.array(total, float) + 0.5) / (sum(total) + 0.5 * CLASSES)
    small = replace(table, counts={})  # for training, which needs no counts

    def train(start: np.ndarray) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, seen, pack = Network(start), 0, struct.Struct("<HBB").pack  # as WORD_OF

            class Words(dict):
                def __missing__(self, word: bytes) -> bytes:
                    found = self[word] = pack(*small.of(word))
                    return found

            known, adam = Words(), Adam(len(net.flat))
            for _, texts in _tokens(batches, []):
                if len(known) > CACHE:
                    known.clear()
                get, end = known.__getitem__, known[b""]
                arrays = [np.frombuffer(b"".join(map(get, t)) + end, WORD_OF) for t in texts]
                train_words(net, adam, arrays)
                seen += sum(map(len, arrays))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([net.flat.astype(float)], pa.list_(pa.float64()))], ["seen", "flat"])

        return run

    parameters = Network(None, share, weights / weights.sum(axis=1, keepdims=True)).flat
    chosen = F.floor(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) / 5) % FIRST == 0
    for part in (chosen, ~chosen):
        copies = training.where(part).select("text").mapInArrow(train(parameters), "seen long, flat array<double>")
        copies = copies.select("seen", F.posexplode("flat").alias("at", "value"))
        means = copies.groupBy("at").agg((F.sum(F.col("value") * F.col("seen")) / F.sum("seen")).alias("value")).toArrow()  # one row a parameter
        parameters[means["at"].to_numpy()] = means["value"].to_numpy()
    return Model(table, parameters.copy(), counts)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole document.

    Documents whose crc32 of the id as text leaves 1 modulo 5 are held out of all learning; a null id counts as an empty
    one and isn't. Null text is empty: its one token is the end. Repeated rows are rows of their own. An empty table
    gives no rows; other columns don't matter, whatever their names. Words without a count are one event in each shared
    class, with the share that words seen once suggest. ``score`` depends a little on how the input is partitioned, as
    every partition trains a copy; all other columns don't. Without ``model`` one is fitted to the documents.
    """
    model = model or fit(docs, id_col, text_col)
    spark, base = docs.sparkSession, _base(docs, id_col, text_col)
    counts, final, tokens = model.counts, model.parameters, model.words.tokens
    small = replace(model.words, counts={})
    shared = spark.sparkContext.broadcast(model.words.counts)
    record = np.dtype([*WORD_OF.descr, ("tail", "u1"), ("base", "<f8"), ("model", "<f8")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, have, scale, pack = Network(final), shared.value, small.base_scale(), struct.Struct("<HBBBdd").pack  # as record
        adds = [small.known_log10(k) for k in range(CLASSES)]

        class Known(dict):
            def __missing__(self, word: bytes) -> bytes:
                (x, k, j), n = small.of(word), have.get(word)
                if n is None:
                    entry = pack(x, k, j, 1, 0.0, 0.0)
                else:
                    entry = pack(x, k, j, 0, math.log10(n + 0.5) - scale, adds[k] + math.log10(n) if k >= OWN and not j else 0.0)
                found = self[word] = entry
                return found

        known = Known()
        for values, texts in _tokens(batches, ["row", "doc_id", "held_out"]):
            if len(known) > CACHE:
                known.clear()
            get, end = known.__getitem__, known[b""]
            a = np.frombuffer(b"".join([b"".join(map(get, t)) + end for t in texts]), record)
            lengths = np.array([len(t) + 1 for t in texts])
            ends = np.cumsum(lengths)
            starts = ends - lengths
            sums = score_words(net, np.split(a[["x", "k", "j"]], ends[:-1])) / math.log(10)
            tail = np.nonzero(a["tail"])[0]
            of = np.searchsorted(ends, tail, "right")
            in_text = tail < ends[of] - 1  # an end that no training text had has no row in the counts
            missing = np.bincount(of[~in_text], minlength=len(texts)) * (math.log10(0.5) - scale)
            rare, of_rare = tail[in_text], of[in_text]
            words = pa.array([texts[i][j] for i, j in zip(of_rare.tolist(), (rare - starts[of_rare]).tolist())], pa.binary()).cast(pa.string())
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of_rare, minlength=len(texts)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([words, pa.array(a["k"][rare].astype(np.int32))], ["w", "k"]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([v[i] for v in values], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))),
                    pa.array(lengths),
                    pa.array(lengths - np.bincount(of, minlength=len(texts))),
                    pa.array(np.add.reduceat(a["base"], starts) + missing),
                    pa.array(np.add.reduceat(a["model"], starts) + sums),
                    lists,
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "tail"],
            )

    scored = written(base.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, tail array<struct<w: string, k: int>>"), "lm-scored")
    # the words that no task's list has: their counts are joined, whatever their number
    classes = spark.createDataFrame([(k, small.known_log10(k), math.log10(small.unknown(k)) if k >= OWN else 0.0) for k in range(CLASSES)], "class int, add double, unseen double")
    rare = scored.select("row", F.explode("tail").alias("t")).select("row", F.col("t.w").alias("w"), F.col("t.k").alias("k"))
    joined = rare.join(counts, F.col("w") == F.col("word"), "left").join(F.broadcast(classes), F.col("k") == F.col("class"))
    n = F.coalesce("n", F.lit(0))
    rare_sums = joined.groupBy(F.col("row").alias("_row")).agg(
        F.count_if(n > 0).alias("_known"),
        F.sum(F.log10(n + 0.5) - small.base_scale()).alias("_base"),
        F.sum(F.when(n > 0, F.col("add") + F.log10(F.greatest(n, F.lit(1)))).otherwise(F.col("unseen"))).alias("_model"),
    )
    out = scored.drop("tail").join(rare_sums, F.col("row") == F.col("_row"), "left")
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("_known", 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("_base", 0.0)).alias("base_score"), (F.col("model") + zero("_model", 0.0)).alias("score"))
