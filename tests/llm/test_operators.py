"""The operators against brute force, and on tables with nulls, blanks, repeats, long texts and clashing names."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from symloom.llm import html_text, jaccard_join, mixing, neighbours, packing, quality_model, quality_rules, queries, recurrent_lm, sharding, stages, url_filter

# Packing


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array(e.ids + [2], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(docs, pieces, capacity=4096):
    rows = pieces.toPandas()
    assert rows.length.sum() == sum(len(i) // 4 for i in ids_of([r["text"] for r in docs.select("text").collect()]))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).to_numpy()
        assert g.offset.iloc[0] == 0 and (g.offset.to_numpy()[1:] == ends[:-1]).all() and ends[-1] <= capacity
    known = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        known[r["doc_id"]].append(ids_of([r["text"]])[0])
    for r in rows.itertuples():
        key = None if r.doc_id != r.doc_id else r.doc_id
        assert any(len(i) // 4 == r.doc_tokens and zlib.crc32(i[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for i in known[key])
    return rows


def test_packing(spark, many):
    rows = check_packing(many, packing.pack_documents(many))
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) + 1


def test_packing_odd(odd, none):
    check_packing(odd, packing.pack_documents(odd))
    assert packing.pack_documents(none).count() == 0


def test_packing_gives_ids(many):
    some = many.where("doc_id < 20")
    rows = packing.pack_documents(some, with_ids=True).toPandas()
    assert (rows.ids.map(zlib.crc32) == rows.ids_crc32).all() and (rows.ids.map(len) == 4 * rows.length).all()


def test_packing_cuts_equal_lengths(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.repeat(F.lit("cat "), 3000).alias("text"))
    rows = check_packing(docs, packing.pack_documents(docs))
    assert rows.sequence_id.nunique() == -(-30 * 3001 // 4096)


@pytest.mark.parametrize("seed", range(5))
def test_best_fill_is_best(seed):
    r = random.Random(seed)
    lengths = sorted({r.randint(1, 30) for _ in range(4)}, reverse=True)
    counts = [r.randint(1, 3) for _ in lengths]
    room = r.randint(5, 70)
    sums = {0}
    for x, n in zip(lengths, counts):
        sums = {s + k * x for s in sums for k in range(n + 1)}
    filled, used = packing.best_fill(room, lengths, counts)
    assert filled == max(s for s in sums if s <= room) == sum(lengths[i] * n for i, n in used.items())
    assert all(n <= counts[i] for i, n in used.items())


def test_encoder_equals_whole_texts():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "İstanbul, ΑΣ. Σίσυφος!", "éa, ö.", "<|endoftext|>a b", "it's, don't. ''' !!, a!!, 3.14 中文。", "\tx\r\n\x0by\x1cz", "H̱ É, ñ!"]
    assert [i + np.array([2], "<u4").tobytes() for i in e.encode(texts)] == ids_of(texts)


# Language model


def test_lm_scores(many):
    rows = {r["doc_id"]: r for r in recurrent_lm.score_documents(many).collect()}
    words = {r["doc_id"]: r["text"].encode().lower().split() + [None] for r in many.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in words}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in words.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_odd(odd, none):
    rows = recurrent_lm.score_documents(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert recurrent_lm.score_documents(none).count() == 0


def test_lm_gradient():
    c, m = recurrent_lm.CLASSES, recurrent_lm
    net, rng = m.Network(None, np.full(c, 1 / c), np.full((c - m.OWN, m.INNER), 1 / m.INNER)), np.random.default_rng(0)
    x, y, j = rng.integers(0, m.START + 1, (6, 5)).astype(np.int16), rng.integers(0, c, (6, 5)).astype(np.int16), rng.integers(0, m.INNER, (6, 5)).astype(np.int16)
    live, state, kept = rng.random((6, 5)) < 0.8, np.zeros((5, m.UNITS), np.float32), m.Network(np.zeros_like(net.flat))
    net.learn(x, y, j, live, state, kept)
    grad = kept.flat.copy()
    inner = kept.inner.ctypes.data - kept.flat.ctypes.data
    tried = [*np.argsort(-np.abs(grad))[:8], *(np.argsort(-np.abs(grad[inner // 4 : inner // 4 + kept.inner.size]))[:4] + inner // 4)]
    for i in tried:
        step = np.zeros_like(grad)
        step[i] = 1e-2
        up, down = (m.Network(net.flat + s * step).learn(x, y, j, live, state, kept)[1] for s in (1, -1))
        assert math.isclose((up - down) / 0.02 / live.sum(), grad[i], rel_tol=0.05, abs_tol=2e-4)


def brute_log10(model, words):
    """The log10 probability of a text (bytes, None for its end), token by token from the formulas."""
    m, v = recurrent_lm, model.words
    net, counts = m.Network(model.parameters), {r["word"].encode(): r["n"] for r in model.counts.collect()}
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    h, x, total, u, mass = np.zeros(m.UNITS), m.START, 0.0, m.UNITS, None
    for w in words:
        w = w or b""
        g = net.inputs[x].astype(float)
        zr = sigmoid(g[: 2 * u] + h @ net.gates)
        c = np.tanh(g[2 * u :] + (zr[u:] * h) @ net.candidate)
        h = (1 - zr[:u]) * h + zr[:u] * c
        classes = softmax(h @ net.out + net.bias)

        def chance(word):
            k = v.class_of(word)
            if k < m.OWN:
                return classes[k]
            within = softmax(h @ net.inner[k - m.OWN] + net.inner_bias[k - m.OWN])
            if word in v.entries:
                return classes[k] * within[v.entries[word]]
            return classes[k] * within[0] * ((1 - v.unknown(k)) * counts[word] / v.rest_total[k] if word in counts else v.unknown(k))

        if mass is None:  # all words with a count and one without in each shared class
            every = sum(chance(x) for x in counts) + sum(classes[k] * softmax(h @ net.inner[k - m.OWN] + net.inner_bias[k - m.OWN])[0] * v.unknown(k) for k in range(m.OWN, m.CLASSES))
            mass = every
        total += math.log10(chance(w))
        x = v.of(w)[0]
    return total, mass


def test_lm_equals_brute_force(spark, many, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "LISTED", 300)  # most words have their counts joined
    docs = many.where("length(text) < 1500").limit(40)
    docs = spark.createDataFrame([*[tuple(r) for r in docs.collect()], (-5, "zzzunseen qqq the of", "en", "s", 0)], docs.schema)
    model = recurrent_lm.fit(docs)
    assert any(n > 0 for n in model.words.entries.values())
    for i, r in enumerate(sorted(recurrent_lm.score_documents(docs, model=model).collect(), key=lambda r: r["doc_id"])):
        if i % 6 == 0 or r["doc_id"] == -5:
            text = docs.where(F.col("doc_id") == r["doc_id"]).first()["text"]
            total, mass = brute_log10(model, [*(text or "").encode().lower().split(), None])
            assert math.isclose(total, r["score"], rel_tol=1e-4, abs_tol=1e-3), r["doc_id"]
            assert 0.9 < mass <= 1 + 1e-6  # a class or entry that no word has keeps its share


# Sharding


def test_sharding(many):
    rows = sharding.shard_documents(many).toPandas().merge(many.toPandas(), on="doc_id")
    assert (rows["size"] == rows.text.map(lambda t: len(t.encode()) + 1)).all() and (rows.text_crc32 == rows.text.map(lambda t: zlib.crc32(t.encode()))).all()
    assert ((rows.grown_shard == rows.shard) | (rows.grown_shard == 16)).all() and (rows.grown_shard == 16).any()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


@pytest.mark.parametrize("n", [3, 16, 17, 40])
def test_one_more_shard_is_the_next_count(spark, n):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    grown = {r["doc_id"]: r["grown_shard"] for r in sharding.shard_documents(docs, n).collect()}
    assert grown == {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, n + 1).collect()}


def test_sharding_odd(odd, none):
    rows = sharding.shard_documents(odd).toPandas()
    assert len(rows) == odd.count() and rows.shard.notna().all()
    assert sharding.shard_documents(none).count() == 0


def test_weights_move_rows_only_where_they_change(spark):
    ids = spark.range(4000)
    tree = sharding.even_tree(16)
    other = [sharding.Shard(s.number, s.region, s.rack, 2.0 if s.number == 0 else 1.0) for s in tree]
    moved = sharding.place(sharding.place(ids, tree, F.col("id"), "a"), other, F.col("id"), "b").where("a <> b").toPandas()
    assert len(moved) and (moved.b < 8).all()  # into the region of the shard that grew
    assert ((moved.b < 4) | (moved.a >= 8)).all()  # within the region, into its rack


# Jaccard join


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (1, 60)])
def test_join_equals_brute_force(spark, k, percent):
    r = random.Random(3)
    texts = ["", None, " \n"] * 3
    for _ in range(80):
        base = [r.choice("abcdefgh") for _ in range(r.choice([1, 2, 3, 5, 8, 20, 40]))]
        for _ in range(r.randint(1, 4)):
            b = list(base)
            if r.random() < 0.7:
                b[r.randrange(len(b))] = r.choice("abcdefgh")
            texts.append(" ".join(b + [r.choice("abcdefgh")] * (r.random() < 0.4)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(tuple(r) for r in jaccard_join.similar(docs, k, percent).collect())
    sizes, least = brute_components(texts, k, percent)
    assert rows == list(zip(range(len(texts)), sizes, least))


def test_join_odd(odd, none):
    rows = jaccard_join.similar(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(3, 1)} and by[9] == {(3, 1)} and by[2] == {(0, 2)} and by[6] == {(max(n for n, _ in by[6]), 5)}
    assert jaccard_join.similar(none).count() == 0


def test_components_of_a_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in jaccard_join.components(links).collect()} == {0}


def test_tiles_equal_plain_pairs():
    r = np.random.default_rng(1)
    base = np.sort(r.integers(0, 2**63, 400, dtype=np.uint64))
    sets = sorted((np.unique(np.concatenate([r.choice(base, 300, replace=False), r.integers(0, 2**63, int(r.integers(0, 200)), dtype=np.uint64)])) for _ in range(40)), key=len)
    sizes, maps = np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets]
    found = {(int(a), int(b)) for i, j, _ in jaccard_join.tile_pairs(sizes, maps, np.arange(40), 60) for a, b in zip(i, j)}
    for i in range(40):
        for j in range(i + 1, 40):
            if jaccard_join.overlap_allows(jaccard_join.overlap(sets[i], sets[j]), len(sets[i]), len(sets[j]), 60):
                assert (i, j) in found


# Mixing


def test_mixing(many):
    rows = mixing.mix_documents(many, carry=["source"]).toPandas()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken / by.target - 1) < 0.05).all() and (rows.taken <= 3 * rows["size"]).all()
    assert abs(by.target.sum() - rows["size"].sum()) < 1
    again = mixing.mix_documents(many, carry=["source"]).toPandas()
    assert sorted(zip(rows.doc_id, rows.taken)) == sorted(zip(again.doc_id, again.taken))


def test_mixing_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 700])), r.choice(["b", "a", None, "c", "a"])) for i in range(300)] + [(5, "x y z", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    plan = mixing.plan_mix(list(sizes.items()), block=16)
    n, step = round(sum(p["slots"] for p in plan)), round(mixing.GOLDEN * 2**31) | 1
    edges = [p["edge"] / plan[-1]["edge"] for p in plan]
    ranks, want = Counter(), Counter()
    placed, _ = mixing._placed(docs, "doc_id", "text", "source", [])
    starts = defaultdict(list)
    for x in placed.where("size > 0").collect():
        starts[x["source_no"]] += [(x["start"], x["doc_id"], w) for w in range(x["size"])]
    assert all(sorted(a + w for a, _, w in v) == list(range(len(v))) for v in starts.values())
    by = {no: {a + w: (d, w) for a, d, w in v} for no, v in starts.items()}
    for t in range(n):
        turn = (t + 1) % 2**31 * step % 2**31 / 2**31
        no = min(sum(e <= turn for e in edges), len(edges) - 1)
        rank, p = ranks[no], plan[no]
        ranks[no] += 1
        if rank < 3 * p["blocks"]:
            for w in range(rank % p["blocks"] * p["long"], min((rank % p["blocks"] + 1) * p["long"], p["size"])):
                want[by[no][w][0]] += 1
    plan_mix = mixing.plan_mix
    try:
        mixing.plan_mix = lambda sizes: plan_mix(sizes, 16)
        taken, pieces = Counter(), Counter()
        for x in mixing.mix_documents(docs).collect():
            taken[x["doc_id"]] += x["taken"]
            assert x["size"] * x["times_min"] <= x["taken"] <= x["size"] * x["times_max"] <= 3 * x["size"]
        for x in mixing.mixed_pieces(docs).collect():
            pieces[x["doc_id"]] += x["words"]
    finally:
        mixing.plan_mix = plan_mix
    assert +taken == +want == +pieces


def test_huge_sources_do_not_overflow(spark, monkeypatch):
    huge = 10**13
    monkeypatch.setattr(mixing, "plan_mix", lambda sizes, f=mixing.plan_mix: [{**p, "size": huge, "blocks": huge // p["long"], "slots": 8.0, "edge": 8.0} for p in f(sizes)])
    monkeypatch.setattr(mixing, "prefix_sums", lambda df, *a: df.withColumn("start", F.lit(huge - 9)))
    docs = spark.createDataFrame([(1, "a b c d e f g h i", "s")], "doc_id long, text string, source string")
    assert mixing.mix_documents(docs).first()["taken"] == 0 and mixing.mixed_pieces(docs).count() == 0


def test_mixing_odd(odd, none):
    rows = mixing.mix_documents(odd).toPandas()
    assert len(rows) == odd.count() and (rows.taken <= 3 * rows["size"]).all()
    assert mixing.mix_documents(none).count() == 0


def test_targets_stop_at_three_times_the_size():
    targets = mixing.share_out([10, 1000, 1000], [3, 1, 2], 2010)
    assert targets[0] == 30 and math.isclose(targets[1], 660) and math.isclose(targets[2], 1320)


# Nearest neighbours


def brute_nearest(rows, k=5):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in fine])
    for n, (i, _) in enumerate(fine):
        if i % 50 == 0:
            s = np.round(unit @ unit[n], 12)
            yield i, [fine[j][0] for j in sorted((j for j in range(len(fine)) if j != n), key=lambda j: (-s[j], fine[j][0]))[:k]]


def test_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = defaultdict(dict)
    for r in neighbours.nearest(vectors).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    want = dict(brute_nearest([tuple(r) for r in vectors.select("vec_id", "embedding").collect()]))
    hits = sum(len(set(got[q].values()) & set(ids)) for q, ids in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (50, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.nearest(df).collect()}
    assert [got[0, k] for k in (1, 2, 3, 4)] == [1, 9, 50, 8] and [got[50, k] for k in (1, 2, 3, 4)] == [0, 1, 9, 8]
    assert neighbours.nearest(df.limit(0)).count() == 0


# Quality rules


def brute_counts(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd, many):
    for docs in (odd.select("doc_id", "text"), many.select("doc_id", "text")):
        got = Counter(tuple(r) for r in quality_rules.text_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == Counter((r["doc_id"], *brute_counts(r["text"])) for r in docs.collect())


def test_quality_rules(many, spark, sf_dir):
    judged = quality_rules.judge_quality(many).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.97 and judged[judged.quality == 0].kept.mean() < 0.4


def test_quality_rules_odd(odd, none):
    rows = quality_rules.judge_quality(odd).toPandas()
    assert len(rows) == odd.count() and not rows[rows.n_words < 50].kept.any()
    assert quality_rules.judge_quality(none).count() == 0


# Quality classifier


def test_classifier(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    judged = quality_model.classify(spark.read.parquet(f"{base}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    assert judged[(judged.quality == 1) & (judged.toxic == 0)].kept.mean() > 0.97
    assert judged[judged.quality == 0].kept.mean() < 0.1 and judged[judged.toxic == 1].kept.mean() < 0.4


def test_classifier_odd(spark, odd, none):
    rows = quality_model.classify(odd, None).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if not (r["text"] or "").split())
    assert set(odd.columns) - {"kept"} <= set(rows[0].asDict())
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(none, labels).count() == 0


def test_a_sample_is_bounded(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("id"), F.lit("same").alias("text"))
    assert sorted(r["id"] for r in quality_model.bounded(df, F.xxhash64("id", "text"), 10).collect()) == [0, 1, 2]
    assert quality_model.bounded(spark.range(500), F.xxhash64("id"), 10).count() == 10


def test_labellers_equal_row_by_row_maximisation():
    r = np.random.default_rng(2)
    truth = r.random(3000) < 0.2
    rows = [[int(x) for x in np.where(r.random(5) < 0.2, 0, np.where((r.random(5) < 0.85) == t, 1, 2))] for t in truth]
    post = quality_model.fit_labellers(dict(Counter(map(quality_model.pattern, rows))), 5, 0.1)
    p = np.array([np.clip((v.count(1) + 0.2) / (v.count(1) + v.count(2) + 2), 0.02, 0.98) for v in rows])
    for _ in range(quality_model.ROUNDS):
        score = np.full(len(rows), math.log(np.clip(p.mean(), 1e-4, 0.9) / (1 - np.clip(p.mean(), 1e-4, 0.9))))
        for j in range(5):
            for vote in range(3):
                has = np.array([v[j] == vote for v in rows])
                a, b = ((has * w).sum() + 0.5 for w in (p, 1 - p))
                score += has * (math.log(a / (p.sum() + 1.5)) - math.log(b / ((1 - p).sum() + 1.5)))
        p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
    assert np.allclose(p, [post[quality_model.pattern(v)] for v in rows], atol=1e-9)
    assert ((p > 0.5) == truth).mean() > 0.9


def test_labellers_are_weighed():
    counts = {quality_model.pattern(v): n for v, n in [([1, 1, 0], 50), ([2, 2, 2], 900), ([0, 0, 1], 5), ([2, 2, 1], 10)]}
    post = quality_model.fit_labellers(counts, 3, 0.1)
    assert post[quality_model.pattern([1, 1, 0])] > 0.9 and post[quality_model.pattern([2, 2, 2])] < 0.1


# HTML


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav>
<div class="cookie-notice">cookies</div><article><h1>A &amp; B</h1><p>one<br>two <b>three<p>four&nbsp;five<div class="ad">buy</div><ul><li>x<li>y</ul><form>f</form><aside>s</aside><p>six<script>z</script> seven</article><section id="comments"><p>first!</p></section><footer>&copy; me</footer></body>"""


def test_page_text(spark):
    df = spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None), (2, None, None), (None, "x", "<p>loose"), (3, "http://h/b", "")], "page_id long, url string, html string")
    rows = html_text.extract_pages(df).toPandas()
    assert len(rows) == 5
    assert rows[rows.page_id == 1].text.item() == "A & B\n\none two three\n\nfour five\n\nx\n\ny\n\nsix seven"
    assert (rows[rows.page_id == 2].text == "").all() and (rows.n_chars == rows.text.map(len)).all()
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_lines_shared_with_the_nearest_page_go(spark):
    page = "<body><div>home</div><div>about</div><p>{}</p><div>imprint</div></body>"
    df = spark.createDataFrame([(i, f"http://h/x/{i}", page.format(f"text {i}")) for i in range(4)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract_pages(df).collect()} == {f"text {i}" for i in range(4)}


def random_pages():
    """Pages of three hosts: marked and unmarked articles, shared menus, copies, repeated rows, ties of path and id."""
    r, rows = random.Random(3), []
    for i in range(240):
        host = r.choice(["a.x", "a.x", "b.y", "c.z"])
        kind, story = r.randrange(4), "".join(f"<p>line {r.randrange(60)} of story {r.randrange(30)}</p>" for _ in range(r.randrange(1, 6)))
        if r.random() < 0.3:
            story = "<p>copied one</p><p>copied two</p>" + ("<p>changed</p>" if r.random() < 0.3 else "")
        body = f"<article>{story}</article>" if kind == 0 else f'<div class="post-content">{story}</div>' if kind == 1 else story
        top = f"<div>home of {host}</div><div>about</div>" + (f"<div>day {r.randrange(3)}</div>" if r.random() < 0.5 else "")
        url = None if r.random() < 0.03 else f"http://{host}/{r.choice('pq')}/{r.randrange(40)}"
        rows.append((None if r.random() < 0.05 else i, url, f"<body>{top}{body}<div>imprint</div></body>"))
    return rows + rows[:20] + [(rows[0][0], rows[0][1], rows[1][2]), (1000, "http://a.x/p/3", "<p>" + "long text " * 60_000 + "</p>" + "".join(f"<p>{i}</p>" for i in range(4000))), (1001, "http://a.x/p/4", None)]


def brute_texts(spark, rows):
    """Every page's text by a search through all pages of its host."""
    df = spark.createDataFrame(rows, "page_id long, url string, html string").fillna("", "html")
    keyed = df.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"), url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path")).distinct().collect()
    pages = []
    for r in keyed:
        lines = html_text.page_lines(r["html"])
        top = max([1] + [x.role for x in lines])
        pages.append((r["host"], r["path"], r["page_id"] is not None, r["page_id"] or 0, r["key"], lines, [x.text for x in lines if x.role == top] or [x.text for x in lines if x.role >= 0], r))
    pages.sort(key=lambda x: x[:5])
    out = {}
    for i, p in enumerate(pages):
        make = lambda q: html_text.Page(q[4], q[1], 0, [x.text for x in q[5]], [x.role for x in q[5]], [len(x.text) for x in q[5]])
        before = next((make(q) for q in reversed(pages[:i]) if q[0] == p[0] and q[6] != p[6]), None)
        after = next((make(q) for q in pages[i + 1 :] if q[0] == p[0] and q[6] != p[6]), None)
        gone = html_text.template_lines(make(p), before, after)
        out[p[7]["page_id"], p[7]["url"], p[7]["html"]] = html_text.main_text(p[5], gone)
    return sorted((str((p, u)), out[p, u, h or ""]) for p, u, h in rows)


def test_pages_equal_brute_force_on_any_partitions(spark, monkeypatch):
    rows = random_pages()
    want = brute_texts(spark, rows)
    assert any("imprint" not in x for _, x in want) and any("copied one" in x for _, x in want)
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id long, url string, html string, key string, host int")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, lines in ((1, 500_000), (8, 0), (40, 500_000)):
            monkeypatch.setattr(html_text, "BROADCAST_LINES", lines)
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted((str((r["page_id"], r["url"])), r["text"]) for r in html_text.extract_pages(df).collect()) == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_templates_and_copies():
    page = lambda key, path, lines: html_text.Page(key, path, key, lines, [0] * len(lines), [10] * len(lines))
    own = page(1, "/a/1", ["menu", "x", "y", "imprint"])
    assert html_text.template_lines(own, page(2, "/a/0", ["menu", "p", "imprint"]), page(3, "/b", ["menu", "q"])) == [0, 3]
    assert html_text.template_lines(own, page(2, "/a/0", ["menu", "x", "y", "z"]), page(3, "/b", ["menu", "q"])) == [0]  # a near copy
    assert html_text.template_lines(own, None, page(3, "/b", ["menu", "q"])) == [0] and html_text.template_lines(own, None, None) == []


@pytest.mark.parametrize("bits", [1 << 28, 16])
def test_alignment_is_longest(bits, monkeypatch):
    monkeypatch.setattr(html_text, "TABLE_BITS", bits)
    r = random.Random(5)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = html_text.shared(a, b)
        rest = iter(b)
        assert len(kept) == table[-1][-1] and all(a[i] in rest for i in sorted(kept))


# URLs


def test_url_rules_are_the_contracts(spark):
    want = {"http://a.net/de/x": "allow", "http://example.net/de/7": "allow", "http://example.net/de/8": "block", "http://a.com/en/x": "block", "http://example.com/en/7": "allow", "http://a.org/es/x": "block"}
    df = spark.createDataFrame(list(want), "string").toDF("url")
    judged = url_filter.judge_urls(df, url_filter.rules_frame(spark, queries.URL_RULES)).collect()
    assert {r["url"]: r["verdict"] for r in judged} == want


def test_urls_equal_sql(spark, sf_dir):
    ours = sorted(tuple(r) for r in queries.op10_url_filters(spark, sf_dir).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    theirs = c.execute(queries.ORACLE["op10_url_filters"]).fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)


def test_urls_odd(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.COM/en/7x?q", "http://com/en/", "http://xcom/en/", "http://a.example.net/de/81#z", "http://net", "http://é.org/es/ñ", "http://u@a.org/es/"]
    urls += ["http://a.net/de/" + "x" * 200_000, *[urls[4]] * 3]
    df = spark.createDataFrame([(i, u, "own", 1, 2, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string, _row int, _s int, `_h.x` string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, url_filter.rules_frame(spark, queries.URL_RULES)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/7x", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block") and got[5][2:] == (None, "allow")
    assert got[6][2:] == ("example.net/de/8", "block") and got[7] == ("net", "", None, "allow") and got[8][2:] == ("org/es/", "block") and got[9][2] == "org/es/"
    assert got[10][2:] == ("net/de/", "block") and got[11] == got[13] == got[4]
    assert url_filter.judge_urls(df, url_filter.rules_frame(spark, queries.URL_RULES)).columns == ["page_id", "url", "_row", "_s", "_h.x", "host", "path", "rule", "verdict"]
    assert url_filter.judge_urls(df.limit(0), url_filter.rules_frame(spark, queries.URL_RULES)).count() == 0
    assert url_filter.judge_urls(df, url_filter.rules_frame(spark, [])).count() == len(urls)


# Pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf_dir), "t")
        assert out.columns == docs.columns and 0 < out.count() <= 3 * docs.count(), name
        if name == "near duplicates":
            groups = jaccard_join.similar(docs, k=5, percent=80)
            assert out.count() == groups.select("component_id").distinct().count()
        docs = out
    check_packing(docs, corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir))


def test_stages_odd(spark, odd):
    kept = stages.one_of_each(odd, jaccard_join.similar(odd, 5, 80))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and {1, 2, 3, 4, 5} <= set(ids) and 9 not in ids and 6 not in ids


# Nearest neighbours where projections tell near from far


def test_neighbours_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 256)
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(32) * 0.05 + c).tolist()) for i, c in enumerate(np.repeat(r.standard_normal((60, 32)), 50, axis=0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(dict)
    for x in neighbours.nearest(df).collect():
        got[x["query_id"]][x["rank"]] = x["vec_id"]
    want = dict(brute_nearest(rows))
    hits = sum(len(set(got[q].values()) & set(ids)) for q, ids in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
    assert neighbours.verified_share(df) < 0.1


def test_neighbours_of_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0, 0.0]), (0, [1.0, 0.0]), (3, [])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, key string, cell int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df).collect())
    assert got == [(0, 1, 0), (0, 2, 1), (50, 1, 2)]


def test_stages_keep_columns_of_any_name(spark, odd, sf_dir):
    import corpus_pipeline

    clashing = ["_key", "_gone", "_row", "_again", "_at", "_times", "_k", "_share", "c__key"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(clashing)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf_dir)
            rows = [tuple(r)[5:] for r in out.collect()]
            assert out.columns == docs.columns and all(r == tuple(range(len(clashing))) for r in rows), name
            assert table is docs or not rows
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()


# Minimum covariance determinant


def numpy_mcd(x, quarter):
    """Means and factor by the same steps over one group's rows."""
    q, floors = quality_rules, np.array(list(quality_rules.STATS.values()))
    factor = lambda c: np.linalg.cholesky(c + np.diag(floors**2))
    at = lambda p: np.sort(x, axis=0)[math.ceil(p * len(x)) - 1]
    some = x[quarter] if quarter.any() else x
    begun = [(at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2)), (x.mean(0), np.cov(x.T, bias=True)), (some.mean(0), np.cov(some.T, bias=True))]
    found = []
    for mean, cov in begun:
        low = factor(cov)
        for _ in range(q.STEPS):
            d = (np.linalg.solve(low, (x - mean).T) ** 2).sum(0)
            level = np.floor(np.log2(d + 1e-6) * q.LEVELS)
            cut = np.sort(level)[math.ceil(q.KEEP * len(x)) - 1]
            near = x[level <= cut]
            mean, low = near.mean(0), factor(np.cov(near.T, bias=True))
        found.append((np.log(np.diag(low)).sum(), mean, low))
    return min(found, key=lambda f: f[0])


def test_mcd_equals_numpy(spark):
    r, names = np.random.default_rng(9), list(quality_rules.STATS)
    rows = []
    for g, n in (("a", 300), ("b", 150), (None, 40)):
        x = r.normal(0, [0.3, 0.05, 0.1, 0.2, 0.1], (n, 5)) + np.outer(r.normal(0, 0.2, n), [1, 0.2, 0, 0.5, 0])
        x[: n // 10] += [0, 1.5, 0, 2, 1]
        rows += [(g, *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} double" for n in names)).withColumn("quarter", F.pmod(F.xxhash64(*names), F.lit(4)) == 0)
    table = df.toPandas()
    for e in quality_rules.mcd(df, ["g"]).collect():
        own = table[table.g.isna() if e["g"] is None else table.g == e["g"]]
        _, mean, low = numpy_mcd(own[names].to_numpy(), own.quarter.to_numpy())
        assert e["rows"] == len(own) and np.allclose(mean, [e[f"m_{i}"] for i in range(5)], atol=1e-9)
        assert np.allclose(low[np.tril_indices(5)], [e[f"l_{i}_{j}"] for i in range(5) for j in range(i + 1)], atol=1e-9)
        assert abs(mean[1]) < 0.05  # the planted outliers don't draw it
