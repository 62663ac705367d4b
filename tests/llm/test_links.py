"""All links of the Jaccard join against brute force, those within a component too."""

import random

import numpy as np
import pytest

from symloom.llm import jaccard_join


def shingles(text, k):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_copies(seed=5):
    r = random.Random(seed)
    texts = ["", None]
    for size, copies in ((40, 12), (30, 9), (60, 20), (8, 3)):  # runs over and under SMALL_RUN
        base = [r.choice("abcdefghijklmnop") for _ in range(size)]
        for _ in range(copies):
            b = list(base)
            b[r.randrange(len(b))] = r.choice("xyz")
            texts += [" ".join(b)] * r.choice([1, 1, 2])
    return texts


@pytest.mark.parametrize(("tile", "shingles_"), [(1024, 300_000), (4, 300_000), (1024, 120)])
def test_all_links_equal_brute_force(spark, monkeypatch, tile, shingles_):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", shingles_)
    monkeypatch.setattr(jaccard_join, "STAR", 5)
    texts, k, percent = near_copies(), 2, 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, k) for t in texts]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    wanted = [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    rows = {r["doc_id"]: r for r in jaccard_join.joined(docs, k, percent).collect()}
    assert [rows[i]["n_links"] for i in range(len(texts))] == wanted and max(wanted) > jaccard_join.SMALL_RUN
    plain = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar(docs, k, percent).collect()}
    assert plain == {i: r["component_id"] for i, r in rows.items()}
    known, pairs = jaccard_join.linked_pairs(docs, k, percent)
    different = set(sets) - {frozenset()}
    assert pairs.count() == pairs.distinct().count() == sum(linked(a, b) for a in different for b in different if a != b) // 2
    assert known.count() == len(texts)


def test_links_of_an_empty_table(none):
    assert jaccard_join.joined(none).count() == 0


@pytest.mark.parametrize("rare", [1, 6])
def test_matrix_equals_sets(monkeypatch, rare):
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 200, dtype=np.uint64)
    make = lambda: np.unique(np.concatenate([r.choice(base, r.integers(100, 200), replace=False), r.integers(0, 2**63, int(r.integers(0, 30)), dtype=np.uint64)]))
    for sizes in ((30, 20), (5, 4), (25, 0)):
        a, b = ([make() for _ in range(n)] for n in sizes)
        hit = jaccard_join.linked_matrix(a, b or None, 60)
        for i, x in enumerate(a):
            for j, y in enumerate(b or a):
                want = (bool(b) or i < j) and jaccard_join.overlap_allows(len(set(x.tolist()) & set(y.tolist())), len(x), len(y), 60)
                assert hit[i, j] == want
    assert hit.any() and not hit.all()
