"""The stored index against BM25 by plain counting, before and after updates and deletes."""

import math
import random
import re
from collections import Counter

import pytest

from symloom.operators import inverted
from symloom.sources import shared
from symloom.sources.versions import Versions


def plain(docs, terms, k):
    bags = {key: Counter(t for t in re.sub(r"[\W_]+", " ", (text or "").lower()).split()) for key, text in docs.items() if key is not None}
    bags = {key: b for key, b in bags.items() if b}
    if not bags:
        return []
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = []
    for key, b in bags.items():
        s = 0.0
        for t in set(terms):
            df = sum(t in x for x in bags.values())
            if b[t]:
                s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
        if s:
            out.append((-round(s, 6), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


def made(n, seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "straße", "über", "x1", "rare"] + [f"w{i}" for i in range(40)]
    weights = [20, 10, 8, 6, 4, 3, 0.2] + [1] * 40
    return {i: (None if i % 50 == 7 else "" if i % 50 == 9 else " ".join(r.choices(words, weights, k=r.randint(1, 60))) + " , ") for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id BIGINT, text STRING")


def found(v, terms, k):
    return [(r["key"], r["score"]) for r in inverted.search(v, terms, k).collect()]


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    v = Versions(spark, str(tmp_path_factory.mktemp("index")))
    docs = made(900, 1)
    inverted.build(v, frame(spark, docs), "id", "text")
    first = dict(docs)
    newer = {i: t for i, t in made(1000, 2).items() if i % 9 == 0 or i >= 900} | {5: "rare rare rare", None: "rare"}
    gone = [11, 12, 27, 5000]
    inverted.update(v, frame(spark, newer), "id", "text", spark.createDataFrame([(i,) for i in gone], "id BIGINT"))
    docs |= newer
    return v, first, {i: t for i, t in docs.items() if i not in gone}


@pytest.mark.parametrize("terms", [["alpha"], ["rare"], ["alpha", "rare", "x1"], ["gamma", "w3", "nothing"], ["nothing"], ["beta", "beta", "alpha", "w1", "w2"]])
def test_search_equals_plain_counting_after_changes(changed, terms):
    v, _, docs = changed
    got, theirs = found(v, terms, 15), plain(docs, terms, 15)
    assert [k for k, _ in got] == [k for k, _ in theirs] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, theirs))


def test_blocks_are_skipped(changed):
    v, _, _ = changed
    _, kept, all_ = inverted.candidate_blocks(v, ["alpha"], 5)
    assert all_ > 5 and kept <= 0.6 * all_


def test_an_older_version_stays(spark, changed):
    v, first, _ = changed
    old = Versions(spark, v.path)
    old.at = 1
    old.tables = __import__("json").loads("".join(r["value"] for r in spark.read.text(f"{v.path}/versions/1.json").collect()))
    assert [k for k, _ in found(old, ["alpha", "rare"], 10)] == [k for k, _ in plain(first, ["alpha", "rare"], 10)]


def test_empty_tables(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "none"))
    assert found(v, ["alpha"], 5) == []
    inverted.build(v, frame(spark, {}), "id", "text")
    assert found(v, ["alpha"], 5) == [] and found(v, [], 5) == []
    inverted.update(v, frame(spark, {1: "alpha", 2: None}), "id", "text")
    assert [k for k, _ in found(v, ["alpha"], 5)] == [1]


def test_symbols_are_searched(spark, changed):
    v, _, docs = changed
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1000)], "id BIGINT, name STRING")
    got = {(r["id"], r["name"]) for r in inverted.search_symbols(v, nodes, ["rare"], 3).collect()}
    assert got == {(k, f"n{k}") for k, _ in plain(docs, ["rare"], 3)}


def test_postings_need_no_shuffle_and_no_copies_are_left(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, None), (None, "a"), (4, "?")], "k long, t string")
    rows = inverted._postings(inverted._analysed(docs, "k", "t"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r["token"], r["key"], r["length"], r["tf"]) for r in rows.collect()} == {("a", 1, 3, 1), ("b", 1, 3, 2), ("a", 2, 1, 1)}
    monkeypatch.setattr(shared, "folder", lambda _: str(tmp_path / "shared"))
    versions = Versions(spark, str(tmp_path / "index"))
    inverted.build(versions, docs, "k", "t")
    inverted.update(versions, docs.where("k = 2"), "k", "t", docs.where("k = 1").select("k"))
    left = {p.name.rpartition("-")[0] for p in (tmp_path / "shared").iterdir()}
    assert not left & {"index-docs", "index-postings"}
    assert [tuple(r) for r in inverted.search(versions, ["a", "b"], 5).select("key").collect()] == [(2,)]
