"""Operators 1, 7 and 8 and the pipeline against brute force."""

import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillbar.llm import jaccard, lines, nearest, partenum, topk, vectors, words
from quillbar.llm.components import components
from quillbar.session import table

from .test_text_operators import near_lines


def shingles(text, width=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.fixture(scope="module")
def family():
    """Random texts, families of near copies around the threshold, tiny and odd texts."""
    rng = np.random.default_rng(11)
    vocabulary = [f"Wörd{i}" for i in range(3000)]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    texts = [" ".join(draw(rng.integers(1, 120))) for _ in range(120)]
    passage = draw(60)
    for n in (6, 9, 12, 40, 90, 150):
        base = draw(n)
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.integers(0, max(2, n // 18) + 1)):
                copy[rng.integers(len(copy))] = vocabulary[rng.integers(3000)]
            if rng.random() < 0.2:
                copy += draw(rng.integers(1, max(2, n // 3)))
            texts.append(" ".join(copy))
    texts += [" ".join(draw(50) + passage + draw(20)) for _ in range(60)]
    texts += [None, "", " \n\t", "a", "A", "a b", "a\tb", "a b c d", "a b c d e", "a b c d e f", "x " * 4000] * 2
    return {int(i) * 3: t for i, t in zip(rng.permutation(len(texts)), texts, strict=True)}


def test_partenum_signatures_are_shared(family):
    sets = [np.array(sorted(hash(x) & (2**64 - 1) for x in shingles(t)), np.uint64) for t in family.values() if t and t.split()]
    for i, x in enumerate(sets):
        for y in sets[i + 1 :]:
            n = len(np.intersect1d(x, y, assume_unique=True))
            if len(x) != n and 100 * n >= 75 * (len(x) + len(y) - n):
                shared = [len(set(partenum.signatures(x, c, d)[0].tolist()) & set(partenum.signatures(y, c, e)[0].tolist())) for c, d in partenum.bands(len(x)) for b, e in partenum.bands(len(y)) if b == c]
                assert max(shared) > 0


def test_jaccard_equals_brute_force(spark, family):
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in family.items()], "doc_id long, text string, component_id int, s string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    want = brute_components(family)
    assert got == want
    assert sum(c != d for d, (_, c) in want.items()) > 60
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_jaccard_odd_inputs(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c"), (7, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(docs).where("doc_id is not null").collect()) == [(5, 3, 5), (5, 3, 5), (7, 0, 7)]
    assert [tuple(r) for r in jaccard.jaccard_components(docs).where("doc_id is null").collect()] == [(None, 1, None)]
    assert jaccard.one_of_each(docs).where("doc_id = 5").count() == 1
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.jaccard_components(only_null).collect()] == [(1, 0, 1)]


def test_rows_that_share_or_lack_a_key_are_kept(spark):
    many = "one two three four five six seven eight nine ten"
    rows = [(None, "x y z"), (None, "u v w"), (5, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m n"), (3, many), (7, many), (7, "p q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in jaccard.one_of_each(docs).collect())
    assert kept == sorted([(0, "x y z"), (0, "u v w"), (5, "a b c d e f g"), (5, "h i j k l m n"), (3, many), (7, "p q r s t u")])


def test_partenum_agreements(family):
    """Similar sets share as many signatures as `agreed` promises, and subsets of two cells are enumerated."""
    rng = np.random.default_rng(5)
    for size in (9, 40, 100, 300):
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for gone in range(0, size // 8 + 1, max(1, size // 24)):
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
            a, b = ({c: partenum.signatures(z, c, d) for c, d in partenum.bands(len(z))} for z in (x, y))
            for c in a.keys() & b.keys():
                assert len(set(a[c][0].tolist()) & set(b[c][0].tolist())) >= a[c][1]
                assert len(a[c][0]) <= partenum.parts(c) == 3 * partenum.groups(c)
    assert all(partenum.agreed(c, partenum.bound(c)) > 0 for c in range(2, 25))


def test_jaccard_of_rows_without_key(spark):
    """They link like others and are named by the smallest key they reach."""
    base = [f"w{i}" for i in range(60)]
    near = [*base[:30], "x", *base[31:]]
    rows = [(9, " ".join(base)), (None, " ".join(near)), (None, " ".join(base)), (4, "\t".join([*base[:-1], "y"])), (None, "alone and apart"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.jaccard_components(docs).collect())
    assert got == sorted([(9, 56, 4), (-1, 56, 4), (-1, 56, 4), (4, 56, 4), (-1, 1, -1), (-1, 0, -1), (-1, 0, -1)])


def test_jaccard_of_one_star_and_of_tabs(spark):
    """Many texts around one centre that are alike in pairs only, with tabs between all words."""
    rng = np.random.default_rng(12)
    passage, texts = [f"p{i}" for i in range(80)], {}
    for i in range(240):
        own = [f"o{i // 3}-{j}" for j in range(40)]
        own[int(rng.integers(40))] = f"r{i}"
        texts[i] = "\t".join([*passage, *own])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(texts)
    ranges = jaccard._block_ranges(docs.select("text"), 5)
    assert set(ranges) <= {6, 7}


HOSTILE = ["whole", "doc", "row", "h", "_gone", "_removed", "_left", "removed", "left", "kept_in", "score", "lang_pred", "known", "s", "key", "at", "nokey", "piece", "text.x"]


def hostile(spark, rows):
    names = ", ".join(f"`{c}` string" for c in HOSTILE)
    return spark.createDataFrame([(*r, *HOSTILE) for r in rows], f"doc_id long, text string, lang string, {names}")


def test_pipeline_stages_with_clashing_names_nulls_and_repeats(spark, tmp_path):
    many = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{many}\nown line of the first", "en"), (1, "z and more words", "en"), (0, "z and more words", None), (None, many, None), (2, many, "en"), (2, many, "en"), (3, None, None), (4, "", "en"), (5, "12 ½ ② ①", None), (None, "Nothing like it", "de")]
    docs = hostile(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    languages = stages["language_id"](spark, docs, "")
    assert languages.columns == docs.columns
    assert sorted(r.text for r in languages.collect()) == sorted(t for _, t, _ in rows if t and any(c.isalpha() for c in t))
    left = stages["line_dedup"](spark, languages, "")
    assert left.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in left.collect())
    assert got == sorted([(1, f"{many}\nown line of the first"), (0, "z and more words"), (-1, many), (-1, "Nothing like it")])
    one = stages["near_duplicates"](spark, languages, "")
    assert one.columns == docs.columns
    assert {tuple(r[c] for c in HOSTILE) for r in one.collect()} == {tuple(HOSTILE)}
    found = stages["pack"](spark, one, "").collect()
    assert len(found) == one.count() and sorted({r.doc_id for r in found if r.doc_id is not None}) == [0, 1]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
        assert none.count() == 0
    docs.drop(*HOSTILE).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4


def test_lines_of_repeated_ids_in_the_query(spark, tmp_path):
    near = " ".join(f"n{i}" for i in range(9))
    rows = [(1, f"S a\nunique words\n{near} one"), (1, "z"), (0, "z"), (1, f"{near} two"), (2, f"{near} two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_lines, r.removed, r.kept_in) for r in lines.op2(spark, str(tmp_path)).collect())
    assert len(got) == 5 and sum(len(x[2]) for x in got) == 3
    assert (0, 1, [], []) in got and (1, 1, [0], [0]) in got and (2, 1, [0], [1]) in got


def test_very_common_lines_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lines, "OFTEN", 7)
    monkeypatch.setattr(lines, "MOST_HOT", 10)
    texts = {i: "the common line\n" + (f"own {i}" if i % 2 else "another one") for i in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc, r.pos): (r.kept_doc, r.kept_pos) for r in lines.removed_lines(docs).collect()}
    assert got == near_lines(texts)


def test_lines_of_rows_that_share_a_key(spark):
    line = lambda c: " ".join(f"{c}{i}" for i in range(9))
    rows = [(1, line("a")), (2, line("b") + "\n" + line("a")), (2, line("c") + "\n" + line("d") + "\n" + line("e")), (2, line("f")), (None, line("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in lines.without_removed(docs).collect())
    assert got == sorted([(0, line("a")), (1, line("a")), (2, line("b")), rows[2], (2, line("f"))])


def test_bound_of_very_large_sets_rules_nothing_out():
    features = np.arange(1_300_000, dtype=np.int64)
    counts = [jaccard.counts_by_bits.func(pd.Series([x])).iloc[0] for x in (features, features[:1000])]
    assert counts[0] == b"" and counts[1]
    at = np.array([0, 1, 0, 1]), np.array([0, 0, 1, 1])
    most = jaccard._most_shared(counts, counts, *at)
    assert most[0] >= len(features) and (7 * most[:3] > 6 * len(features)).all() and most[3] == 1000


def test_language_stage_without_labels(spark):
    rows = [(1, "Some words", None), (2, "12 + 3", None), (3, None, None), (4, "слово", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_word_hashes_fold_ascii_only():
    a, b, c = (words.word_hashes([x.encode()])[0].tolist() for x in ("Äb CD\x0be", "Äb cd e", "äb cd e"))
    assert a == b and a != c
    assert len(words.word_hashes([b"", b" x ", b"y" * 1000])[0]) == 2


def cosine_oracle(rows, k, every):
    ids = [i for i, v in rows]
    m = np.array([v for _, v in rows], float)
    m = m / np.sqrt((m * m).sum(1))[:, None]
    out = {}
    for i, q in zip(ids, m, strict=True):
        if i % every == 0:
            out[i] = sorted(((-float(s), j) for j, s in zip(ids, m @ q, strict=True) if j != i))[:k]
    return out


def test_nearest_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want, found = cosine_oracle(rows, 5, 50), {}
    for r in nearest.op7(spark, sf).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = sum(len({j for _, j in want[q]} & {v for v, _ in found[q].values()}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert all(sorted(f) == [1, 2, 3, 4, 5] for f in found.values())
    by_id = dict(rows)
    for q, f in found.items():
        for v, s in f.values():
            a, b = np.array(by_id[q], float), np.array(by_id[v], float)
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


VECTORS = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [-0.5, 0.25]), (11, [])]


def vector_frame(spark, rows=VECTORS):
    return spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_nearest_odd_inputs(spark):
    rows = nearest.with_length(vectors.clean(vector_frame(spark), "vec_id", "embedding"))
    got = {}
    for r in nearest.search(rows, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got[0]) == [(1, 3), (2, 4), (3, 50), (4, 100)]
    assert sorted(got[50]) == [(1, 0), (2, 3), (3, 4), (4, 100)]
    assert nearest.search(rows.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("times", [2, 6])
def test_nearest_of_repeated_rows(spark, times):
    """Every row is a candidate of its own, so copies take places; a repeated query is one query."""
    rng = np.random.default_rng(8)
    once = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    rows = [(i, v, 0) for i, v in once * times]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>, other int").repartition(4)
    want, found = cosine_oracle(once, 5, 50), {}
    for r in nearest.search(frame, F.col("vec_id") % 50 == 0, 5).collect():
        assert r["rank"] not in found.setdefault(r.query_id, {})
        found[r.query_id][r["rank"]] = r.vec_id
    expect = {q: [j for _, j in near for _ in range(times)][:5] for q, near in want.items()}
    assert all(sorted(found[q]) == [1, 2, 3, 4, 5] for q in want)
    assert sum(found[q][k + 1] == expect[q][k] for q in want for k in range(5)) >= 0.9 * 5 * len(want)


def test_nearest_recall_without_the_sample_holding_all(spark, monkeypatch):
    """Recall of the lists and the scan themselves: the sample holds a fraction of the rows."""
    monkeypatch.setattr(nearest, "SAMPLE", 800)
    rng = np.random.default_rng(21)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.uniform(-1, 1, (8000, 32)).round(4))]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(4)
    want, found = cosine_oracle(rows, 5, 50), {}
    for r in nearest.search(frame, F.col("vec_id") % 50 == 0, 5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(found[q]) == 5 for q in want)
    assert sum(len({j for _, j in want[q]} & found[q]) for q in want) >= 0.9 * 5 * len(want)


def test_short_queries_are_scanned_again(spark, monkeypatch):
    """A test that abandons all it can still leaves k rows a query."""
    monkeypatch.setattr(nearest, "EPSILON", -5.0)
    rng = np.random.default_rng(22)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    want, found = cosine_oracle(rows, 5, 50), {}
    for r in nearest.search(frame, F.col("vec_id") % 50 == 0, 5).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(v) for q, v in found.items()} == dict.fromkeys(want, 5)


def test_queries_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = sorted((r["rank"], r.vec_id) for r in nearest.search(frame, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]
    whole = frame.withColumn("vector", topk.whole_numbers("vector"))
    got = sorted((r["rank"], r.vec_id) for r in topk.top_k(whole, F.col("vec_id") % 100 == 0, 10).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_top_k_of_repeated_rows_and_huge_components(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1e300, 0.0]), (7, [-1e300, -1e300]), (8, [4e12, -4e12])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    whole = frame.withColumn("vector", topk.whole_numbers("vector"))
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(whole, F.col("vec_id") % 100 == 0, 10).orderBy("rank").collect()]
    a, b = 1024, 2048
    assert got == [(1, 6, topk.MOST), (2, 5, a * a + a * b), (3, 5, a * a + a * b), (4, 8, 4096 * 10**12 * (a - b)), (5, 7, topk.LEAST)]


def test_adaptive_scan_keeps_the_nearest():
    rng = np.random.default_rng(2)
    data = nearest.unit(rng.standard_normal((3000, 64)) + 2 * rng.standard_normal((8, 64))[rng.integers(0, 8, 3000)])
    data = data @ np.linalg.qr(rng.standard_normal((64, 64)))[0]
    exact = ((data[:40, None, :] - data[None, :, :]) ** 2).sum(2)
    near = np.argsort(exact, axis=1)[:, :6]
    row, query = nearest.scan(data, data[:40], np.take_along_axis(exact, near[:, 5:6], 1)[:, 0] + 1e-9)
    found = set(zip(query.tolist(), row.tolist(), strict=True))
    assert sum((q, r) in found for q in range(40) for r in near[q].tolist()) >= 0.97 * 240
    assert len(found) < 40 * 300


def test_top_k_odd_inputs_and_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = VECTORS + [(200 + i, rng.normal(size=6).round(2).tolist()) for i in range(150)]
    found = vectors.clean(vector_frame(spark, rows), "vec_id", "embedding")
    whole = found.withColumn("vector", F.transform("vector", lambda x: F.floor(x * 1024).cast("long")))
    got = {}
    for r in topk.top_k(whole, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    clean = {r.vec_id: r.vector for r in whole.collect()}
    for q in (i for i in clean if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(clean[q], v, strict=False)), i) for i, v in clean.items() if i != q)[:10]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(scores)}
    assert topk.top_k(whole.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0


def test_pipeline_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    letters = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    texts = {r.doc_id: r.text for r in docs.collect() if letters(r.text)}
    gone = near_lines(texts)
    left = {}
    for d, t in texts.items():
        rest = [x for p, x in enumerate(t.split("\n")) if (d, p) not in gone]
        if any(x.split() for x in rest) or len(rest) == len(t.split("\n")):
            left[d] = "\n".join(rest)
    classes = brute_components(left)
    final = {d: t for d, t in left.items() if classes[d][1] == d}
    tokenizer, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), set()
    for d, t in final.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.add((d, k, len(part), zlib.crc32(part.tobytes())))
    got, bins = corpus_pipeline.run(spark, sf).collect(), {}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert ends[:-1] == [a for a, _ in sorted(parts)] and ends[-1] <= 4096
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, sf).columns == docs.columns
