"""Packing of documents into sequences by minimum bin slack.

A document's ids are cut into windows of the capacity and a remainder. The remainders' lengths make a histogram, which is
bounded by the capacity whatever the number of documents. The plan is made from it: the longest length left seeds a
window, and subset-sum dynamic programming over bitsets picks the multiset of other lengths that fills it closest to
the capacity, with counts found by backtracking. The pattern is applied as often as the histogram allows. If a pattern
leaves more slack than is tolerated, one more piece is cut to fill it, and the rest of it goes back to the histogram.
Ranks of the pieces within their length then lead to windows and offsets.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, kept, prefix_sums, small_batches, written

#: Ids in a sequence, the id that ends a document, and the slack that is left rather than cut for.
CAPACITY, END, SLACK = 4096, 2, 8
#: Up to this many cut pieces, their documents are found by a broadcast of ids; more are found by a shuffle.
BROADCAST_CUTS = 200_000
#: Blank-separated pieces whose ids a worker keeps, in each of two generations.
CACHE = 150_000
#: ASCII punctuation that never joins a word before it; the apostrophe may.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Pieces(dict):
    """Ids of pieces, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.make(piece)
        return found


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit ids, by a cache of the ids of blank-separated pieces.

    For byte-level byte-pair tokenizers that compose characters, drop white space, lower the case and split off words of
    letters, so that a text's ids are those of its pieces in turn. A piece that is a word of letters and punctuation
    after it goes to the model as these two units; any other goes through the whole tokenizer. With a tokenizer of any
    other kind, whole texts go through it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.whole = not self._splits_at_blanks(json.loads(self.tokenizer.to_str()))
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = _Pieces(self._found)
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}

    @staticmethod
    def _splits_at_blanks(parts: dict) -> bool:
        """Whether the tokenizer is of the kind whose ids of a text are those of its blank-separated pieces."""
        steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        splits = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        regex = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
        return (
            steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
            and splits[0].get("behavior") == "Removed"
            and splits[0].get("invert") is True
            and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in regex
            and not splits[1].get("add_prefix_space")
            and not splits[1].get("use_regex")
            and parts["model"]["type"] == "BPE"
            and not parts["model"].get("dropout")
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.pieces) > CACHE:
            self.old, self.pieces = self.pieces, _Pieces(self._found)
        get = self.pieces.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]

    def _found(self, piece: str) -> bytes:
        return self.old.get(piece) or self._one(piece)

    def _one(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if not word.isalpha():
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        low = word.lower()
        if not word.isascii():
            # lowering must not depend on what stands around, nor call for composing anew
            if "\u03a3" in word or not (is_normalized("NFC", word) and is_normalized("NFC", low)) or not low.isalpha():
                return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
            low = low.encode().decode("latin-1").translate(self.alphabet)
        end = piece[len(word) :]
        if end not in self.ends:
            if len(self.ends) > 10_000:
                self.ends = {"": b""}
            self.ends[end] = np.array(self.tokenizer.encode(end, add_special_tokens=False).ids, "<u4").tobytes()
        ids = self.pieces.get(low) if word.isascii() else None
        if ids is None:
            packed = self.packed
            ids = b"".join([packed[t.id] for t in self.model.tokenize(low)])
            if word.isascii():
                self.pieces[low] = ids
        return ids + self.ends[end]


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary; a Python worker keeps it for the tasks to come."""
    return kept(("encoder", path), lambda: Encoder(path))


@dataclass
class Plan:
    """Where the pieces go. A class is a length with its slots 0 to n - 1; a segment is a run of slots of a class.

    kind 0: slot s goes to window ``first + (s - start) // times`` at ``offset + (s - start) % times * length``.
    kind 1: slot s is cut: ``head`` ids go to window ``first + (s - start)`` at ``offset``, the others are slot
    ``child_start + s - start`` of class ``child``.
    """

    lengths: list[int] = field(default_factory=list)
    segments: list[tuple] = field(default_factory=list)  # class, start, kind, times, first, offset, head, child, child_start
    windows: int = 0
    cuts: int = 0

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        s = np.array(sorted(self.segments), np.int64).reshape(-1, 9)
        return np.array(self.lengths, np.int64), s


def best_fill(room: int, lengths: list[int], counts: list[int]) -> tuple[int, dict[int, int]]:
    """The most of ``room`` that a multiset of ``lengths`` with those counts fills, and the counts used.

    Bit ``b`` of a set says that ``b`` can be reached; copies of a length are added in powers of two, and the sets
    before each addition are kept to go back through.
    """
    full, reached = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i, (length, count) in enumerate(zip(lengths, counts)):
        count, copies = min(count, room // length), 1
        while count > 0:
            take = min(copies, count)
            steps.append((i, take, reached))
            reached |= (reached << (take * length)) & full
            count, copies = count - take, copies * 2
        if reached >> room & 1:
            break
    top = reached.bit_length() - 1
    used: dict[int, int] = {}
    at = top
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            used[i] = used.get(i, 0) + take
            at -= take * lengths[i]
    return top, used


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, slack: int = SLACK) -> Plan:
    """Packs ``histogram`` (length: number of pieces, no length over capacity)."""
    plan = Plan()
    left: dict[int, list[list[int]]] = {}  # length: runs (class, next slot, count)
    order: list[int] = []  # lengths with pieces, ascending
    total: dict[int, int] = {}

    def add(length: int, cls: int, start: int, count: int) -> None:
        if length not in total:
            insort(order, length)
            total[length], left[length] = 0, []
        left[length].append([cls, start, count])
        total[length] += count

    def new_class(length: int) -> int:
        plan.lengths.append(length)
        return len(plan.lengths) - 1

    def drop(length: int) -> None:
        if not total[length]:
            del total[length], left[length]
            order.pop(bisect_left(order, length))

    def take(length: int, times: int, repeat: int, offset: int) -> None:
        """``times`` pieces of a length into each of the next ``repeat`` windows."""
        window, need = plan.windows, repeat
        while need:
            cls, start, count = run = left[length][0]
            whole = min(need, count // times)
            if whole:
                plan.segments.append((cls, start, 0, times, window, offset, length, -1, 0))
                run[1], run[2] = start + whole * times, count - whole * times
                window, need = window + whole, need - whole
                total[length] -= whole * times
            else:  # the run ends inside a window: its pieces go one by one, the window is filled from the next runs
                at, missing = offset, times
                while missing:
                    run = left[length][0]
                    some = min(missing, run[2])
                    plan.segments.append((run[0], run[1], 0, some, window, at, length, -1, 0))
                    run[1], run[2] = run[1] + some, run[2] - some
                    at, missing = at + some * length, missing - some
                    total[length] -= some
                    if not run[2]:
                        left[length].pop(0)
                window, need = window + 1, need - 1
                continue
            if not run[2]:
                left[length].pop(0)

    def cut(length: int, head: int, repeat: int, offset: int) -> None:
        """The first ``head`` ids of a piece of a length into each of the next ``repeat`` windows."""
        window, need, child, at = plan.windows, repeat, new_class(length - head), 0
        while need:
            run = left[length][0]
            some = min(need, run[2])
            plan.segments.append((run[0], run[1], 1, 1, window, offset, head, child, at))
            run[1], run[2] = run[1] + some, run[2] - some
            window, need, at = window + some, need - some, at + some
            total[length] -= some
            if not run[2]:
                left[length].pop(0)
        plan.cuts += repeat
        add(length - head, child, 0, repeat)

    for length in sorted(histogram):
        if histogram[length]:
            add(length, new_class(length), 0, histogram[length])
    while order:
        seed = order[-1]
        room = capacity - seed
        uses = {seed: 1}
        if room:
            fit = order[: bisect_left(order, room + 1)][::-1]
            filled, used = best_fill(room, fit, [total[x] - (x == seed) for x in fit])
            for i, n in used.items():
                uses[fit[i]] = uses.get(fit[i], 0) + n
            room -= filled
        repeat = min(total[x] // n for x, n in uses.items())
        split = 0
        if room > slack:  # fill the slack from the longest piece that is left beside the pattern
            for x in reversed(order):
                # a piece of this length more in each window
                if x > room and total[x] > uses.get(x, 0):
                    split, repeat = x, min(repeat, total[x] // (uses.get(x, 0) + 1)) or 1
                    break
        offset = 0
        for x, n in uses.items():
            take(x, n, repeat, offset)
            offset += n * x
        if split:
            cut(split, room, repeat, offset)
        plan.windows += repeat
        for x in {*uses, *([split] if split else [])}:
            drop(x)
    return plan


def place(cls: np.ndarray, slot: np.ndarray, plan: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of pieces by class and slot: (row, start in the piece, length, window, offset) arrays, cut after cut."""
    _, seg = plan
    keys = seg[:, 0] << 40 | seg[:, 1]  # class and slot as one number: slots stay under 2^40
    row, begin = np.arange(len(cls)), np.zeros(len(cls), np.int64)
    while len(row):
        at = np.searchsorted(keys, cls << 40 | slot, "right") - 1
        s = seg[at]
        past = slot - s[:, 1]
        whole = s[:, 2] == 0
        window = s[:, 4] + np.where(whole, past // s[:, 3], past)
        offset = s[:, 5] + np.where(whole, past % s[:, 3] * s[:, 6], 0)
        yield row, begin, s[:, 6], window, offset
        more = ~whole
        row, begin, cls, slot = row[more], begin[more] + s[more, 6], s[more, 7], s[more, 8] + past[more]


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` ids; a row a piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and text_key (a hash of the text), with
    ``with_ids`` also ids, the piece's ids as little-endian 32-bit bytes.

    Null text is empty: its document is the id ``end`` alone. Repeated rows and null ids are documents of their own.
    An empty table gives no rows. Only the last window may be left with much room.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keyed = base.withColumn("text_key", F.xxhash64("_text"))
    pieces = written(_pieces(keyed, tokenizer_path, capacity, end), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = make_plan(histogram, capacity)
    arrays = spark.sparkContext.broadcast((plan.arrays(), {x: i for i, x in enumerate(sorted(histogram))}))
    rows = sum(histogram.values())
    ranked = prefix_sums(pieces, ["length"], ["doc_id", "text_key", "start"], {"slot": F.lit(1)}, buckets_for(rows, 512))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planned, classes = arrays.value
        for p in parts:
            if not len(p):
                continue
            cls = p["length"].map(classes).to_numpy(np.int64)
            for row, begin, length, window, offset in place(cls, p["slot"].to_numpy(np.int64), planned):
                q = p.iloc[row]
                whole = length == q["length"].to_numpy()
                yield pd.DataFrame({"doc_id": q["doc_id"].array, "start": q["start"].to_numpy() + begin, "length": length, "ids_crc32": pd.array(np.where(whole, q["ids_crc32"].to_numpy(), -1), "Int64"), "doc_tokens": q["doc_tokens"].to_numpy(), "sequence_id": window, "offset": offset, "text_key": q["text_key"].to_numpy()})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, text_key long"
    placed = written(ranked.select(F.col("doc_id").cast("long").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "slot", "text_key").mapInPandas(assign, schema), "pack-placed")
    if not plan.cuts and not with_ids:
        return placed
    whole, cut = placed.where("ids_crc32 >= 0"), placed.where("ids_crc32 < 0")
    if with_ids:
        whole, cut = placed.limit(0), placed
    # only the documents of cut pieces are encoded again
    wanted = cut.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    few = plan.cuts <= BROADCAST_CUTS and not with_ids
    again = keyed.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    again = again.select(F.col("doc_id").cast("long").alias("_id"), F.col("text_key").alias("_key"), "_text")
    found = cut.join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select(*cut.columns, "_text")
    path = tokenizer_path

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(_path(path))
        tail = np.array([end], "<u4").tobytes()
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                q = batch.slice(at, 250)
                ids = [(x + tail)[4 * a : 4 * (a + n)] for x, a, n in zip(coder.encode(q.column("_text").to_pylist()), q.column("start").to_pylist(), q.column("length").to_pylist())]
                sums = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                columns = [sums if c == "ids_crc32" else q.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names + ["ids"] * with_ids)

    summed = found.mapInArrow(checksum, schema + ", ids binary" * with_ids)
    return summed if with_ids else whole.unionByName(summed)


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(keyed: DataFrame, path: str | None, capacity: int, end: int) -> DataFrame:
    """Windows and remainder of each document with their checksums."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(_path(path))
        tail, wide = np.array([end], "<u4").tobytes(), 4 * capacity
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_key"]
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                rows = []
                for i, ids in enumerate(coder.encode(part.column("_text").to_pylist())):
                    ids += tail
                    n = len(ids)
                    rows += [(i, b // 4, (min(b + wide, n) - b) // 4, zlib.crc32(ids[b : b + wide]), n // 4) for b in range(0, n, wide)]
                a = np.array(rows, np.int64).reshape(-1, 5)
                row = pa.array(a[:, 0].copy())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), *(pa.array(a[:, c].copy()) for c in range(1, 5)), part.column("text_key").take(row)], names)

    return keyed.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(encode, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, text_key long")
