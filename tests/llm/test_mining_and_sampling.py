"""Operators 11 to 13 against brute force, with nulls, ties, repeats, long texts and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbar.llm import minhash, negatives, resampling

from .test_joins_and_searches import shingles


def brute_components(texts, width, percent):
    sets = {d: shingles(t, width) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.fixture(scope="module")
def copies():
    """Random texts, families of near copies around 0.8, tiny and odd texts, one very long pair."""
    rng = np.random.default_rng(3)
    vocabulary = [f"Wörd{i}" for i in range(2000)]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, 2000, n)]
    texts = [" ".join(draw(rng.integers(1, 120))) for _ in range(120)]
    for n in (3, 5, 8, 20, 60, 150):
        base = draw(n)
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.integers(0, max(2, n // 10) + 1)):
                copy[rng.integers(len(copy))] = vocabulary[rng.integers(2000)]
            texts.append(" ".join(copy))
    long = draw(30_000)
    texts += [" ".join(long), " ".join(long[:29_000] + draw(900)), "x y " * 9000]
    texts += [None, "", " \n\t", "a", "A", "a b", "a\tb", "a b c d e f", "a b c d e"] * 2
    return {int(i) * 3: t for i, t in zip(rng.permutation(len(texts)), texts, strict=True)}


def test_minhash_equals_brute_force(spark, copies):
    docs = spark.createDataFrame([(d, t, 1, "c", True) for d, t in copies.items()], "doc_id long, text string, component_id int, s string, kept boolean").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    want = brute_components(copies, 2, 80)
    assert got == want
    assert sum(c != d for d, (_, c) in want.items()) > 60


def test_table_keys_pair_sketches_of_two_collections():
    """All pairs of sketches are keys; similar sets share about as many as their similarity says, others none."""
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    assert len(minhash.table_keys(x)) == minhash.COLLECTIONS**2 and len(minhash.minima(x)) == 2 * minhash.COLLECTIONS * minhash.JOINED
    y = np.concatenate([x[:450], rng.integers(0, 1 << 63, 50).astype(np.uint64)])  # 0.818
    shared = np.intersect1d(minhash.table_keys(x), minhash.table_keys(y))
    assert len(shared) >= minhash.LEAST
    one, other = (minhash.minima(z).reshape(2, minhash.COLLECTIONS, minhash.JOINED) for z in (x, y))
    same = (one == other).all(2).sum(1)
    assert len(shared) == same[0] * same[1]
    assert not len(np.intersect1d(minhash.table_keys(x), minhash.table_keys(rng.integers(0, 1 << 63, 500).astype(np.uint64))))


def test_minhash_odd_rows(spark):
    schema = "doc_id long, text string"
    many = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(5, many), (5, many), (None, many), (7, None), (9, many + " x"), (None, "lone words here")], schema)
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(5, 59, 5, True), (5, 59, 5, True), (None, 59, 5, False), (7, 0, 7, True), (9, 60, 5, False), (None, 2, None, True)])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def brute_negatives(rows, positives=5, kept=3):
    out = []
    for a, la, va in dict.fromkeys(rows):
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), c, label) for c, label, v in rows if c != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            s = -s
            wrong = [(n, -m) for m, n, label in scored if label != la and 50 * s <= -100 * m and -100 * m <= 95 * s]
            out += [(a, p, i + 1, n, s, m) for i, (n, m) in enumerate(wrong[:kept])]
    return Counter(out)


@pytest.mark.parametrize("case", ["spread", "ties", "clusters", "huge"])
def test_negatives_equal_brute_force(spark, case, monkeypatch):
    rng = np.random.default_rng(9)
    n, width = 900, 6
    label = np.where(rng.random(n) < 0.34, 0, rng.integers(0, 12, n))
    v = rng.integers(-90, 91, (n, width))
    if case == "ties":
        v = rng.integers(0, 3, (n, width))
    if case == "clusters":
        v = rng.integers(-200, 201, (8, width))[rng.integers(0, 8, n)] + rng.integers(-9, 10, (n, width))
    if case == "huge":
        v = v.astype(np.int64) << 22
    rows = [(int(i), int(x), tuple(map(int, y))) for i, (x, y) in enumerate(zip(label, v, strict=True))]
    rows += rows[:120]  # repeated rows
    rows += [(100, 3, tuple(map(int, v[7]))), (150, int(label[150]), tuple(map(int, v[8])))]  # one id, other values
    monkeypatch.setattr(negatives, "ROWS", 128)
    monkeypatch.setattr(negatives, "ANCHORS", 32)
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>").repartition(3)
    got = Counter(tuple(r) for r in negatives.mined(df, F.col("vec_id") % 50 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == brute_negatives(rows) and len(got) > 20


def test_negatives_do_not_depend_on_how_blocks_meet(spark, monkeypatch):
    """Many blocks on both sides, joined by shuffles as large tables are."""
    rng = np.random.default_rng(10)
    rows = [(i, int(rng.integers(0, 6)), tuple(map(int, rng.integers(-50, 51, 4)))) for i in range(3000)]
    monkeypatch.setattr(negatives, "ROWS", 200)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    apart = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in apart}
    for k, v in apart.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
        got = Counter(tuple(r) for r in negatives.mined(df, F.col("vec_id") % 50 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_negatives(rows)


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 301, (10, 5))[rng.integers(0, 10, 3000)] + rng.integers(-9, 10, (3000, 5))
    tree = negatives.Tree(np.arange(3000), np.zeros(3000, np.int64), v.astype(np.int16))
    q = rng.integers(-300, 301, (40, 5))
    search = negatives.Search(tree, q, np.full(40, -1), np.zeros(40, np.int64), np.arange(40), np.full(40, -np.inf), np.full(40, np.inf), 5, True)
    for node in range(len(tree.first)):
        inside = q @ tree.vectors[tree.first[node] : tree.last[node]].astype(np.int64).T
        least, most, _ = search.bounds(np.arange(40), np.full(40, node))
        assert (inside >= least[:, None]).all() and (inside <= most[:, None]).all()
    read, plain, plain_by = [], search.read, search.read_by
    search.read = lambda unit, leaf: (read.append(len(unit)), plain(unit, leaf))[1]
    search.read_by = lambda unit, leaf: (read.append(len(unit)), plain_by(unit, leaf))[1]
    search.run()
    assert sum(read) < 40 * (len(tree.first) - tree.leaves) / 4


def test_negatives_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, score string, query int"
    good = [(i, [float(i % 7) + 0.5, 1.0], i % 2, "x", 1) for i in range(1, 60)] + [(50, [3.0], 1, "x", 1), (100, [], 0, "x", 1)]
    odd = [(None, [1.0, 1.0], 1, "x", 1), (150, None, 1, "x", 1), (200, [1.0, None], 1, "x", 1), (250, [float("nan"), 1.0], 1, "x", 1), (300, [float("inf"), 1.0], 1, "x", 1), (350, [1.0, 1.0], None, "x", 1)]
    mine = lambda rows: negatives.mined(negatives.clean(spark.createDataFrame(rows, schema), "vec_id", "embedding", "label").withColumn("vector", negatives.whole_numbers("vector")), F.col("vec_id") % 50 == 0)
    got = Counter(tuple(r) for r in mine(good + odd).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    padded = [(i, label, tuple((*(math.floor(256 * x) for x in v), 0, 0))[:2]) for i, v, label, _, _ in good]
    assert got == brute_negatives(padded) and got
    assert mine(good[:1]).count() == 0 and negatives.mined(negatives.clean(spark.createDataFrame([], schema), "vec_id", "embedding", "label").withColumn("vector", negatives.whole_numbers("vector")), F.col("vec_id") % 50 == 0).count() == 0


def brute_resampled(docs, target, longest, share=10):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets(x))
    for x in target:
        t.update(buckets(x))
    total, aimed = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * aimed)))
    rows = []
    for d, x in docs:
        found = buckets(x)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: share * len(able) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    rng = np.random.default_rng(8)
    words = ["the", "Of", "ünd", "x1", "don't", "a-b", "字符", "\x00nul", "É", "zebra"] + [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n)) + rng.choice([".", "!?", "\n", ""])
    docs = [(i, draw(rng.integers(1, 90))) for i in range(250)]
    docs += [(1000, draw(60_000)), (1001, "z" * 200_000), (1002, "q " * 90_000), (1003, "_" * 100_000), (3, docs[3][1]), (None, draw(40)), (None, draw(40)), (2000, None), (2001, ""), (2002, "...")]
    target = [draw(30) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(d, x, 1, 2.0, "x") for d, x in docs], "doc_id long, text string, rank int, weight double, row string").repartition(4)
    got = resampling.resampled(frame, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute_resampled(docs, target, longest)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_chunks_own_each_start_once(longest):
    rng = np.random.default_rng(4)
    text = " ".join("w" * int(n) for n in rng.integers(1, 30, 2000)).encode() + b" ..  end"
    whole = Counter(resampling.features(len(text), text, longest)[1])
    for size in (1, 7, 64, 1000, 10**6):
        parts = list(resampling.chunks(text, longest, size))
        assert sum(n for n, _ in parts) == len(text)
        found = Counter()
        words = 0
        for owned, part in parts:
            own, run = resampling.features(owned, part, longest)
            found.update(run)
            words += own
        assert found == whole and words == 2001


def test_resampling_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resampled(empty, target).count() == 0
    docs = spark.createDataFrame([(1, "a b " * 30), (2, None)], "doc_id long, text string")
    assert Counter(tuple(r) for r in resampling.resampled(docs, empty).collect()) == brute_resampled([(1, "a b " * 30), (2, None)], [], 1)
