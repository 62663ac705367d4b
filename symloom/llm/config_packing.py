"""Packing of whole documents into few sequences by a configuration linear program.

Documents longer than a sequence are cut into full pieces, the first of which may be shorter; no other document is cut. The
pieces' lengths make a histogram, bounded by the capacity whatever the number of documents. A configuration is a multiset of
lengths that fits a sequence. The linear program, to cover the histogram with as few configurations as can be, is solved by
multiplicative weights: each length has a price, a knapsack dynamic program finds the configurations dearest at these
prices, these are used some more, and lengths that are covered become cheaper. The uses are rounded down, what is left is
solved again, and the last few pieces go where they fit best. Ranks of the pieces within their length then lead to sequences.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, kept, prefix_sums, small_batches, written
from .packing import MARKS, Plan, _Pieces, place

#: Ids in a sequence and the id that ends a document.
CAPACITY, END = 2048, 0
#: Rounds of pricing of a program, configurations taken in a round, step of the weights, programs solved for what is left.
ROUNDS, SEEDS, STEP, PROGRAMS = 80, 32, 0.1, 6
#: Added to the first prices, as a share of the lengths.
LITTLE = 0.02
#: A configuration is used while this share of it is left.
FILLED = 0.98
#: A program is solved once its sequences are within this share of the bound that the prices prove.
GAP = 0.001
#: Letters up to here are classed alike by all versions of Unicode.
LATIN = "ɏ"
#: Pieces that an encoder keeps before it begins a new cache beside the old one, and words of a text made of new ones.
PIECES, TOGETHER = 400_000, 5_000


def _letters(word: str) -> bool:
    """Whether a word is letters alone, which all versions of Unicode class alike."""
    return word.isalpha() and (word.isascii() or max(word) <= LATIN)


class SpacedEncoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit ids, by a cache of the ids of pieces with the space before.

    For byte-level byte-pair tokenizers that split texts before a space and change nothing else: a single space between
    other characters always begins a new unit, so a text's ids are those of its pieces in turn. Pieces at other white space
    stay with their neighbours, but for single line ends between other characters, which are units of their own. New words of
    a batch go through the tokenizer together, as one text, whose ids are cut where a space or line end begins. With a
    tokenizer of any other kind, whole texts go through it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        split, model = parts.get("pre_tokenizer") or {}, parts["model"]
        self.whole = not (
            parts.get("normalizer") is None
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and (model["type"], model.get("dropout"), bool(model.get("ignore_merges"))) == ("BPE", None, False)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts.get("added_tokens", []))
        )
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.space = chr(self.alphabet[32])
        self.pieces, self.old, self.ends = _Pieces(self._found), {}, {"": b""}
        self.lines: dict[str, bytes] = {}  # ids of a line end and the word after it
        self.between = re.compile(r"(?<=\S) (?=\S)")
        tokens = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.begins[[i for t, i in tokens.items() if t.startswith((self.space, chr(self.alphabet[10])))]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.pieces) > PIECES:
            self.old, self.pieces = self.pieces, _Pieces(self._found)
        if len(self.lines) > PIECES:
            self.lines = {}
        split = [t.split(" ") for t in texts]
        self._learn(set().union(*(s[1:] for s in split)).difference(self.pieces))
        return [self._text(t, s) for t, s in zip(texts, split)]

    def _learn(self, new: set[str]) -> None:
        """Finds the ids of those new pieces that are words with punctuation after them, on one line or several."""
        pieces, old = self.pieces, self.old
        words, lines, ended, several = set(), set(), [], []
        for piece in new:
            if (known := old.get(piece)) is not None:
                pieces[piece] = known
                continue
            word = piece.rstrip(MARKS)
            if _letters(word):
                words.add(word)
                if len(word) < len(piece):
                    ended.append(piece)
            elif "\n" in piece and all(map(_letters, parts := [x.rstrip(MARKS) for x in piece.split("\n")])):
                several.append(piece)
                words.add(parts[0])
                lines.update(parts[1:])
        words = words.difference(pieces)
        if old:
            again = {w: known for w in words if (known := old.get(w)) is not None}
            pieces.update(again)
            words.difference_update(again)
        self._together(" ", [*words], pieces)
        self._together("\n", [*lines.difference(self.lines)], self.lines)
        for piece in ended:
            word = piece.rstrip(MARKS)
            pieces[piece] = pieces[word] + self._end(piece[len(word) :])
        for piece in several:
            head, *rest = piece.split("\n")
            word = head.rstrip(MARKS)
            pieces[piece] = pieces[word] + self._end(head[len(word) :]) + b"".join([self.lines[w := x.rstrip(MARKS)] + self._end(x[len(w) :]) for x in rest])

    def _together(self, before: str, words: list[str], to: dict[str, bytes]) -> None:
        """Puts the ids of words of letters, with a space or line end before, into ``to``."""
        texts = [before + before.join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        for n, found in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            some, ids = words[n * TOGETHER : (n + 1) * TOGETHER], np.array(found.ids, "<u4")
            raw, cuts = ids.tobytes(), [*(4 * np.nonzero(self.begins[ids])[0]).tolist(), 4 * len(ids)]
            if len(cuts) - 1 != len(some):  # a vocabulary without the space or line end
                to.update((w, self._plain(before + w)) for w in some)
            else:
                to.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))

    def _end(self, end: str) -> bytes:
        """Ids of punctuation after a word."""
        if end not in self.ends:
            if len(self.ends) > 10_000:
                self.ends = {"": b""}
            self.ends[end] = self._plain(end)
        return self.ends[end]

    def _text(self, text: str, split: list[str]) -> bytes:
        head, *rest = split
        if not rest:
            return self._plain(text)
        if not (head and (head[0].isspace() or head[-1].isspace())):
            found = [*map(self.pieces.__getitem__, rest)]
            if None not in found:
                return self._plain(head) + b"".join(found)
        head, *rest = self.between.split(text)
        return self._plain(head) + b"".join([x if (x := self.pieces[p]) is not None else self._plain(" " + p) for p in rest])

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def _found(self, piece: str) -> bytes | None:
        """Ids of a piece after a space; None if white space at its ends may belong to a unit around it."""
        if piece in self.old:
            return self.old[piece]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        word = piece.rstrip(MARKS)
        if not _letters(word):
            return self._plain(" " + piece)
        end = piece[len(word) :]
        if end:
            return self.pieces[word] + self._end(end)
        return np.array([t.id for t in self.tokenizer.model.tokenize(self.space + word.encode().decode("latin-1").translate(self.alphabet))], "<u4").tobytes()


def encoder(path: str) -> SpacedEncoder:
    """The process's encoder for a vocabulary; a Python worker keeps it for the tasks to come."""
    return kept(("spaced-encoder", path), lambda: SpacedEncoder(path))


class Knapsack:
    """The dearest multiset of lengths, with their counts at most, for every room up to the capacity.

    Copies of a length are added in powers of two; what each addition changed is kept to go back through.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.capacity, self.items = capacity, []
        for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
            count, copies = min(count, capacity // length), 1
            while count > 0:
                take = min(copies, count)
                self.items.append((i, take, take * length))
                count, copies = count - take, copies * 2
        self.taken = np.zeros((len(self.items), capacity + 1), bool)

    def price(self, prices: np.ndarray) -> np.ndarray:
        """The worth of the dearest multiset by room."""
        best = np.zeros(self.capacity + 1)
        values = prices.tolist()
        for k, (i, copies, length) in enumerate(self.items):
            more = best[:-length] + values[i] * copies
            np.greater(more, best[length:], out=self.taken[k, length:])
            np.maximum(more, best[length:], out=best[length:])
        return best

    def multisets(self, rooms: np.ndarray, kinds: int) -> np.ndarray:
        """Counts by length of the dearest multisets for ``rooms``, a row each."""
        at, rows, out = rooms.copy(), np.arange(len(rooms)), np.zeros((len(rooms), kinds), np.int64)
        for k in range(len(self.items) - 1, -1, -1):
            taken = self.taken[k, at]
            if taken.any():
                i, copies, length = self.items[k]
                out[rows[taken], i] += copies
                at -= length * taken
        return out


@dataclass
class Solution:
    uses: np.ndarray  # a configuration a row, counts by length
    times: np.ndarray  # how often the linear program uses it
    bound: float  # no packing has fewer sequences


def first_prices(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Prices in proportion to the lengths, or those of a better bound; and the bound on the number of sequences.

    With a threshold, lengths that leave less room than it cost a whole sequence, shorter ones than it nothing: no
    configuration costs more than 1. A little is added in proportion, so that room is used.
    """
    size, best, bound = lengths / capacity, lengths / capacity, float((lengths * counts).sum() / capacity)
    for least in range(1, capacity // 2 + 1, max(1, capacity // 128)):
        prices = np.where(lengths > capacity - least, 1.0, np.where(lengths < least, 0.0, size))
        if (worth := float((prices * counts).sum())) > bound:
            best, bound = prices, worth
    return best + LITTLE * size, bound


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, seeds: int = SEEDS, step: float = STEP) -> Solution:
    """The configuration program of a histogram by multiplicative weights.

    Prices fall with what of a length is covered. A round takes the dearest
    configurations around the lengths that are covered least, each so often that it uses up one of its lengths.
    """
    (base, bound), cover = first_prices(lengths, counts, capacity), np.zeros(len(lengths))
    sack, found = Knapsack(lengths, counts, capacity), {}
    for _ in range(rounds):
        weights = cover / counts
        prices = base * np.exp(-step * (weights - weights.min()))
        best = sack.price(prices)
        bound = max(bound, float((prices * counts).sum() / best[capacity]))
        least = np.argsort(weights, kind="stable")[:seeds]
        uses = sack.multisets(capacity - lengths[least], len(lengths))
        uses[np.arange(len(least)), least] += 1
        for row in uses[(uses <= counts).all(axis=1)]:
            often = float((counts[row > 0] / row[row > 0]).min())
            key = row.astype(np.int32).tobytes()
            found[key] = found.get(key, 0.0) + often
            cover += row * often
        evenly = cover.sum() and sum(found.values()) / (cover / counts).min() if cover.min() > 0 else 0
        if evenly and evenly <= bound * (1 + GAP):
            break
    uses = np.array([np.frombuffer(k, np.int32) for k in found], np.int64).reshape(-1, len(lengths))
    share = float((cover * lengths).sum() / (counts * lengths).sum()) or 1.0
    return Solution(uses, np.array(list(found.values())) / share, bound)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, programs: int = PROGRAMS) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Configurations (length: count) with how often each is used, packing ``histogram`` exactly; and the proven bound.

    Uses of a program are rounded down, and a configuration goes without pieces that others have used up; the next program
    packs the rest.
    """
    rows: list[tuple[dict[int, int], int]] = []
    left = {x: n for x, n in histogram.items() if n > 0}
    if capacity in left:
        rows.append(({capacity: 1}, left.pop(capacity)))
    full, bound = sum(n for _, n in rows), 0.0
    for k in range(programs):
        if len(left) < 2 and k:
            break
        if not left:
            break
        lengths = np.array(sorted(left, reverse=True))
        counts = np.array([left[x] for x in lengths.tolist()])
        solved = solve(lengths, counts, capacity, ROUNDS // (1 + k) + 10)
        bound = bound or full + solved.bound
        before = int(counts.sum())
        for c in np.argsort(-solved.times, kind="stable").tolist():
            often = int(solved.times[c])
            if not often:
                break
            row = np.minimum(solved.uses[c], counts // often)
            if int(row @ lengths) >= FILLED * int(solved.uses[c] @ lengths):
                counts -= row * often
                rows.append(({int(x): int(n) for x, n in zip(lengths[row > 0], row[row > 0])}, often))
        left = {int(x): int(n) for x, n in zip(lengths, counts) if n}
        if before - sum(left.values()) < before // 20:
            break
    return _last(rows, left, capacity), bound


def _last(rows: list[tuple[dict[int, int], int]], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Puts the pieces ``left``, longest first, where they leave the least room; into new sequences where there is none."""
    made, open_ = [[dict(r), n] for r, n in rows], []
    for i, (row, _) in enumerate(made):
        room = capacity - sum(x * n for x, n in row.items())
        if room:
            insort(open_, (room, i))
    for length in sorted(left, reverse=True):
        need = left[length]
        while need:
            at = bisect_left(open_, (length, -1))
            if at == len(open_):
                each = capacity // length
                often, rest = divmod(need, each)
                if often:
                    made.append([{length: each}, often])
                    if capacity - each * length:
                        insort(open_, (capacity - each * length, len(made) - 1))
                if rest:
                    made.append([{length: rest}, 1])
                    insort(open_, (capacity - rest * length, len(made) - 1))
                break
            room, i = open_[at]
            row, often = made[i]
            each = min(room // length, need)
            some = min(often, need // each)
            filled = dict(row)
            filled[length] = filled.get(length, 0) + each
            made[i][1] -= some
            if not made[i][1]:
                open_.pop(at)
            made.append([filled, some])
            if room - each * length:
                insort(open_, (room - each * length, len(made) - 1))
            need -= each * some
    return [(row, n) for row, n in made if n]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, float]:
    """Where the pieces go, by length and rank (see ``packing.place``), and the bound on the number of sequences."""
    rows, bound = pack_histogram(histogram, capacity)
    plan = Plan(lengths=sorted(histogram))
    cls, slot = {x: i for i, x in enumerate(plan.lengths)}, dict.fromkeys(histogram, 0)
    for row, often in rows:
        offset = 0
        for length, times in row.items():
            plan.segments.append((cls[length], slot[length], 0, times, plan.windows, offset, length, -1, 0))
            slot[length] += times * often
            offset += times * length
        plan.windows += often
    return plan, bound


def pack_whole(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Packs every document into few sequences of at most ``capacity`` ids; a row a piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document of at most ``capacity`` ids is one
    piece; a longer one has pieces of ``capacity`` ids, the first of which has what is over.

    Null text is empty: its document is the id ``end`` alone. Repeated rows and null ids are documents of their own, in any
    order among equals. Very long texts are encoded whole. An empty table gives no rows. Other columns of ``docs`` are not
    read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = written(_pieces(keyed, tokenizer_path, capacity, end), "whole-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan, _ = make_plan(histogram, capacity)
    arrays = spark.sparkContext.broadcast((plan.arrays(), {x: i for i, x in enumerate(plan.lengths)}))
    ranked = prefix_sums(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], {"slot": F.lit(1)}, buckets_for(sum(histogram.values()), 512))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planned, classes = arrays.value
        for p in parts:
            if len(p):
                ((_, _, _, window, offset),) = place(p["length"].map(classes).to_numpy(np.int64), p["slot"].to_numpy(np.int64), planned)
                yield p.drop(columns="slot").assign(sequence_id=window, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "slot").mapInPandas(assign, schema)


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pieces(keyed: DataFrame, path: str | None, capacity: int, end: int) -> DataFrame:
    """The pieces of each document with their checksums."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = encoder(_path(path)), np.array([end], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part, rows = batch.slice(at, 250), []
                for i, ids in enumerate(coder.encode(part.column("text").to_pylist())):
                    ids += tail
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    rows += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                a = np.array(rows, np.int64).reshape(-1, 5)
                columns = [pa.array(a[:, c].copy()) for c in range(1, 5)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(a[:, 0].copy())), columns[0].cast(pa.int32()), *columns[1:]], names)

    return keyed.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")
