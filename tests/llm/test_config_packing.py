"""Packing of whole documents: the pieces against plain tokenizing, sequences against bounds."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symloom.llm import config_packing, queries

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(docs, packed, tokenizer, capacity=2048):
    rows = packed.toPandas()
    assert list(rows.columns) == COLUMNS
    expected = Counter()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    total = 0
    for (d, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)):
        ids = np.array(e.ids + [0], "<u4").tobytes()
        n = len(ids) // 4
        total += n
        first = n % capacity or min(n, capacity)
        cuts = [0] + list(range(first, n + 1, capacity))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[(d, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == expected
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).to_numpy()
        assert g.offset.iloc[0] == 0 and (g.offset.to_numpy()[1:] == ends[:-1]).all() and ends[-1] <= capacity
    return rows, total


def test_whole_table(spark, sf_dir, many, tokenizer):
    rows, total = check(many, queries.QUERIES["op13_best_fit_packing"](spark, sf_dir), tokenizer)
    assert rows.sequence_id.nunique() <= 1.01 * -(-total // 2048) + 1


def test_odd_tables(odd, none, tokenizer):
    check(odd, config_packing.pack_whole(odd), tokenizer)
    out = config_packing.pack_whole(none)
    assert out.count() == 0 and out.columns == COLUMNS


def test_exact_lengths(spark, tokenizer):
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" cat"), F.expr("CAST(2045 + id % 6 AS INT)")).alias("text"))
    rows, _ = check(docs, config_packing.pack_whole(docs), tokenizer)
    assert rows.groupby("doc_id").size().max() == 2 and (rows[rows.piece == 1].length == 2048).all()


@pytest.mark.parametrize("seed", range(4))
def test_encoder_equals_whole_texts(tokenizer, seed):
    r = random.Random(seed)
    bits = ["word", "Wörter", "don't", "we'll", "'s", "a.b", "(x)", "12", "3rd", "漢字", "é", "é", "ǅ", " ", "\x1c", "\x85", "\n", "\n\n", "\t", "", "", "<|endoftext|>", "...", "ſ", "naïve,", "--", "　", "ʼn", "😀", "x\ny", "z\n", "\nq"]
    texts = ["", " ", "  a", "a ", "a  b", " \n a"] + [" ".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(400)]
    ours = config_packing.SpacedEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not ours.whole
    theirs = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ours.encode(texts) == theirs == ours.encode(texts)


def test_encoder_of_another_kind():
    other = config_packing.SpacedEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.whole and len(other.encode(["two words"])[0]) >= 8


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_is_dearest(seed):
    r = random.Random(seed)
    lengths = np.array(sorted({r.randint(1, 15) for _ in range(4)}, reverse=True))
    counts = np.array([r.randint(1, 4) for _ in lengths])
    prices, room = np.array([r.random() for _ in lengths]), 25
    best = {0: 0.0}
    for x, n, p in zip(lengths.tolist(), counts.tolist(), prices):
        best = {s: max(best.get(s - k * x, -np.inf) + k * p for k in range(n + 1)) for s in range(room + 1) if any(s - k * x in best for k in range(n + 1))}
    sack = config_packing.Knapsack(lengths, counts, room)
    worth = sack.price(prices)
    (row,) = sack.multisets(np.array([room]), len(lengths))
    assert np.isclose(worth[room], max(best.values())) and np.isclose(row @ prices, worth[room])
    assert row @ lengths <= room and (row <= counts).all()


def least_bins(items, capacity):
    """The fewest sequences, by trying all."""
    items = sorted(items, reverse=True)

    def fits(i, rooms):
        if i == len(items):
            return True
        for room in {x for x in rooms if x >= items[i]}:
            rest = list(rooms)
            rest.remove(room)
            if fits(i + 1, [*rest, room - items[i]]):
                return True
        return False

    n = -(-sum(items) // capacity)
    while not fits(0, [capacity] * n):
        n += 1
    return n


@pytest.mark.parametrize("seed", range(12))
def test_few_sequences_on_small_tables(seed):
    r = random.Random(seed)
    items = [r.randint(3, 14) for _ in range(r.randint(1, 11))]
    rows, bound = config_packing.pack_histogram(dict(Counter(items)), 20)
    packed = Counter()
    for row, often in rows:
        assert sum(x * n for x, n in row.items()) <= 20
        packed.update({x: n * often for x, n in row.items()})
    assert packed == Counter(items)
    used, least = sum(n for _, n in rows), least_bins(items, 20)
    assert bound - 1e-6 <= least <= used <= least + 1


@pytest.mark.parametrize(("low", "high", "slack"), [(1, 2047, 1.02), (600, 800, 1.09), (30, 300, 1.001)])
def test_near_the_bound(low, high, slack):
    r = random.Random(1)
    histogram = Counter(r.randint(low, high) for _ in range(8000))
    rows, bound = config_packing.pack_histogram(dict(histogram))
    packed = defaultdict(int)
    for row, often in rows:
        for x, n in row.items():
            packed[x] += n * often
    assert packed == histogram and sum(n for _, n in rows) <= slack * bound + 1


def test_times_of_a_million_copies():
    rows, bound = config_packing.pack_histogram({700: 10**9, 648: 10**9, 2048: 5})
    assert sum(n for _, n in rows) <= 1.01 * bound and len(rows) < 1000


def test_new_words_of_a_batch_are_encoded_together(monkeypatch):
    ours, alone = config_packing.SpacedEncoder(public_tokenizers.path("byte_bpe_50k.json")), []
    plain = ours._plain
    monkeypatch.setattr(ours, "_plain", lambda text: alone.append(text) or plain(text))
    texts = [f"Head wordy{chr(97 + i)} lasting.\nNext{chr(97 + i)}, über.\nÉté 'tis a\n\nb" for i in range(20)]
    want = [np.array(ours.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ours.encode(texts) == want
    assert {t for t in alone if t.strip() not in {"Head", ".", ",", "'tis", "a\n\nb"}} == set()
