"""Operators 2, 4, 5, 6, 9, 10 and 3: brute force, round trips, held-out accuracy and odd inputs."""

import base64
import hashlib
import math
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillbar.llm import bpe, byte_bpe, html, language, licenses, lines, packing, training_order
from quillbar.session import table

ODD = ["", " ", "\n\n \t x", "a" * 700, "ab" * 400 + " " * 300, "<|endoftext|> hi <|startoftext|>x", "don't I'LL we've 'S", "ΑΣ ΣΑΣ. İI é é 가 日本語 🙂👨‍👩‍👧", "_a__b 12 ½ ²①", "\x1c\x1d a\x85b", None, "½ ② ①", "Ⅷ ༳"]
CLASH = "doc_id long, text string, lang string, ids string, n_tokens string, score string, piece string, `_removed` string, key string"


def odd_docs(spark, texts=ODD):
    rows = [(i, t, "en" if i % 2 else None, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r.text for r in table(spark, sf, "documents").orderBy("doc_id").limit(60).collect()]


def test_byte_bpe_equals_tiktoken(spark, texts):
    ranks, expect = byte_bpe.ranks_file(), {}
    table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table_, special_tokens={})
    docs = odd_docs(spark, ODD + texts)
    for row in docs.collect():
        ids = reference.encode_ordinary(row.text or "")
        raw = np.array(ids, "<u4").tobytes()
        expect[row.doc_id] = (len(ids), hashlib.sha256(raw).hexdigest(), (row.text or "").encode())
    got = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN), ranks)
    assert {r.doc_id: (r.n_tokens, r.h, bytes(r.decoded)) for r in got.withColumn("h", F.sha2("ids", 256)).collect()} == expect
    assert byte_bpe.encode(docs.limit(0), ranks, P.PATTERN).count() == 0


def test_pieces_and_packing(spark, texts):
    longer = " ".join(texts)
    all_texts = ODD + texts + [longer, longer]
    docs = odd_docs(spark, all_texts)
    found = packing.packed_documents(docs).collect()
    reference, expect = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for i, text in enumerate(all_texts):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expect[i, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == expect
    bins: dict = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(x[1] for x in expect.values()) // 4096) + 2
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # Greedy: 60 + 30 + 5; two documents of 20 fit where 30 + 5 left room for no more.
    counts = np.zeros(101, np.int64)
    for n in (60, 30, 20, 20, 5):
        counts[n] += 1
    mixes = packing.best_two_fit(counts, 100)
    used = Counter()
    for times, mix in mixes:
        assert sum(n * u for n, u in mix) <= 100
        for n, u in mix:
            used[n] += times * u
    assert used == Counter({60: 1, 30: 1, 20: 2, 5: 1})
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    mixes = packing.best_two_fit(counts, 100)
    total = sum(times for times, _ in mixes)
    assert total <= -(-int((counts * np.arange(101)).sum()) // 100) * 1.01


def test_language_accuracy_and_unknowns(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.op4(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()
    assert found.where("score < 0 or score > 1").count() == 0
    odd = odd_docs(spark)
    model = language.fit(docs, language.held_out())
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    for i, t in enumerate(ODD):
        assert (got[i] == ("und", 0.0)) == (not any(unicodedata.category(c)[0] == "L" for c in t or "")), t
    assert {r.lang_pred for r in language.predict(odd, language.fit(docs.limit(0), language.held_out())).collect()} == {"und"}


def test_language_model_equals_plain_kernel_ridge(spark):
    """The same model from dictionaries of n-grams: no hashing into cells, no batches, no packed profiles."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund liegt auf der matte", "de"), ("a dog and the cat", "en"), ("die katze und der hund", "de"), ("the mat was red", "en"), ("das haus ist rot", "de")])]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(False), landmarks=4, per_language=50)

    def cells(text):
        row = np.zeros(language.DIM)
        language.profile(text, row)
        return set(np.flatnonzero(row).tolist())

    def grams(text):
        fold = "".join(c if c.isalpha() or ord(c) >= 128 else " " for c in text.lower()).encode()
        return {fold[i : i + n] for n in (1, 2, 3) for i in range(len(fold) - n + 1)}

    assert all(0 <= len(grams(t)) - len(cells(t)) <= 3 for _, t, _ in rows)  # cells hold the n-grams, but for collisions
    points = [set(np.flatnonzero(p).tolist()) for p in model["points"]]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    train = [(cells(t), lang) for _, t, lang in rows * 2]
    across = np.array([[kernel(x, p) for p in points] for x, _ in train])
    among = np.array([[kernel(p, q) for q in points] for p in points])
    target = np.array([[1.0 if lang == n else -1.0 for n in model["labels"]] for _, lang in train])
    weights = np.linalg.solve(across.T @ across + language.RIDGE * len(train) * among + 1e-8 * np.eye(len(points)), across.T @ target)
    asked = [*(t for _, t, _ in rows), "the hund", "x", "katze"]
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame.unionByName(frame), model).collect()}
    for i, t in enumerate(asked):
        scores = np.array([kernel(cells(t), p) for p in points]) @ weights
        best = int(scores.argmax())
        assert got[i][0] == model["labels"][best] and abs(got[i][1] - min(1, max(0, (scores[best] + 1) / 2))) < 1e-4


def near_lines(texts, least=8):
    """Brute force of the line rule."""
    every = [(d, p, tuple(line.split())) for d, t in sorted(texts.items()) for p, line in enumerate(t.split("\n")) if line.split()]

    def close(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    first: dict = {}
    for d, p, w in every:
        first.setdefault(w, (d, p))
    out = {}
    for d, p, w in every:
        keep = min(at for v, at in first.items() if close(v, w))
        if keep != (d, p):
            out[d, p] = keep
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts, kept = {}, []
    for d in range(80):
        rows = []
        for _ in range(rng.integers(0, 6)):
            if kept and rng.random() < 0.6:
                row = list(kept[rng.integers(len(kept))])
                at = int(rng.integers(len(row)))
                action = rng.integers(4)
                if action == 1:
                    row[at] = vocabulary[rng.integers(40)]
                elif action == 2 and len(row) > 1:
                    del row[at]
                elif action == 3:
                    row.insert(at, vocabulary[rng.integers(40)])
            else:
                row = [vocabulary[i] for i in rng.integers(0, 40, rng.integers(1, 14))]
            kept.append(row)
            rows.append("  ".join(row))
        texts[d] = "\n".join(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()] + [(500, None, "x")], "doc_id long, text string, doc string")
    got = {(r.doc, r.pos): (r.kept_doc, r.kept_pos) for r in lines.removed_lines(docs).collect()}
    want = near_lines(texts)
    assert got == want and len(want) > 50
    left = {r.doc_id: r.text for r in lines.without_removed(docs).collect()}
    for d, t in texts.items():
        rows = t.split("\n")
        rest = [x for p, x in enumerate(rows) if (d, p) not in want]
        if any(x.split() for x in rest) or len(rest) == len(rows):
            assert left[d] == "\n".join(rest)
        else:
            assert d not in left
    assert left[500] is None


def test_line_dedup_odd_inputs(spark):
    template = " ".join(["same"] * 9)
    rows = [(1, "a\n\nb\r\n  \n"), (2, " a \nB"), (3, None), (None, "a\nb"), (4, "x " * 3000), (5, "x " * 3000 + "y"), (7, "a"), (7, "a")]
    rows += [(100 + i, f"{template} {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.pos): (r.kept_doc, r.kept_pos) for r in lines.removed_lines(docs).collect()}
    expect = {(2, 0): (1, 0), (5, 0): (4, 0), (7, 0): (1, 0)} | {(100 + i, 0): (100, 0) for i in range(1, 60)}
    assert got == expect
    assert lines.removed_lines(docs.limit(0)).count() == 0
    assert lines.without_removed(docs).where("doc_id is null").count() == 1


def test_html_layout():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var t="</p>";</script>
    <h1>Head</h1><p>One <b>two</b>&amp;three<p>Four<br>five<div hidden>no</div><div style="display: none">no</div>
    <ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><table><caption>Cap</caption><tr><th>Name<th>N<tr><td>long name<td>1</table>
    <pre>x  y
 z</pre><noscript>no</noscript><span>tail</span>"""
    assert html.extract(page) == "Head\n\nOne two&three\n\nFour\nfive\n\n- a\n- b\n  3. c\n  4. d\n\nCap\nName      | N\nlong name | 1\n\nx  y\n z\n\ntail"
    assert html.extract("") == "" and html.extract("just text") == "just text"
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_html_operator(spark, sf):
    docs = spark.createDataFrame([(1, None, "c"), (2, "<p>x</p>", "c"), (2, "<p>x</p>", "c")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html.extract_text(docs).collect()) == [(1, None), (2, "x"), (2, "x")]
    assert html.extract_text(docs.limit(0)).count() == 0
    pages = table(spark, sf, "pages")
    assert html.op6(spark, sf).where("n_chars > 0").count() == pages.count()


def test_license_notices(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "at no charge").upper()
    rows = [(1, f"é prose here\n{mit}\nmore"), (2, "Words.\nReleased under the MIT License.\nWords"), (3, changed), (4, None), (5, ""), (6, "All of the rights, under the law"), (7, "x " * 9000 + licenses.TEMPLATES["ISC"]), (2, "Words.\nReleased under the MIT License.\nWords")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license string")
    found = licenses.scan(docs).collect()
    got = {(r.doc_id, r.license): r for r in found}
    assert set(got) == {(1, "MIT"), (2, "MIT-notice"), (3, "MIT"), (7, "ISC")} and len(found) == 5
    assert got[1, "MIT"].coverage == 1.0 and got[3, "MIT"].coverage > 0.9
    text = rows[0][1]
    assert text[got[1, "MIT"].span_start : got[1, "MIT"].span_end] == mit.rstrip(".")
    assert rows[1][1][got[2, "MIT-notice"].span_start : got[2, "MIT-notice"].span_end] == "Released under the MIT License"
    assert licenses.scan(docs.limit(0)).count() == 0


def found_in(index, text):
    words, begin, end, count = licenses.word_hashes([text.encode()], licenses.NOT_ALNUM)
    return [(index.names[t], n) for _, t, n, _, _ in licenses.notices(index, words, np.array([0, len(words)]))]


def test_whole_license_texts_are_told_apart():
    texts = licenses.public_templates()
    index = licenses.Index(texts)
    for name, text in texts.items():
        assert found_in(index, f"Some words before.\n{text}\nand after.") == [(name, int(index.size[index.names.index(name)]))], name
    tied = licenses.Index({"first": licenses.TEMPLATES["ISC"], "second": licenses.TEMPLATES["ISC"]})
    assert found_in(tied, licenses.TEMPLATES["ISC"]) == [("first", 34)]


def test_license_alignment_equals_the_unbanded_one():
    """Edits that move no word out of the band: as many words match as in the longest common subsequence."""

    def longest_common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    rng, index = np.random.default_rng(0), licenses.Index(licenses.public_templates())
    for name in ("MIT", "ISC", "Apache-2.0", "BSD-3-Clause", "Zlib", "GPL-3.0"):
        template = index.words[index.names.index(name)].tolist()
        for _ in range(6):
            words = list(template)
            for _ in range(int(rng.integers(0, len(template) // 14 + 1))):
                at, kind = int(rng.integers(len(words))), rng.integers(3)
                words[at : at + (kind != 2)] = [] if kind == 1 else [int(rng.integers(1 << 60))]
            around = rng.integers(0, 1 << 60, 20).tolist()
            text = np.array(around + words + around, np.uint64)
            matched, first, last = licenses.align(np.array(template, np.uint64), text, np.array([20]), np.array([0]), np.array([len(text)]))
            assert matched[0] == longest_common(template, text.tolist())
            assert 20 <= first[0] <= last[0] < 20 + len(words)


def test_notice_dense_texts_cost_linear_time():
    index = licenses.Index(licenses.public_templates())
    few = licenses.TEMPLATES["MIT"] + " the terms of this license " + licenses.TEMPLATES["BSD-2-Clause-grant"] + " "
    times = []
    for n in (60, 240):
        words = licenses.word_hashes([(few * n).encode()], licenses.NOT_ALNUM)[0]
        began = time.process_time()
        assert len(licenses.notices(index, words, np.array([0, len(words)]))) == 2 * n
        times.append(time.process_time() - began)
    assert times[1] < 8


def test_license_candidates_miss_nothing(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {(r.doc_id, r.n) for r in docs.select("doc_id", (F.size(F.split("text", r"(?i)released under the mit license")) - 1).alias("n")).where("n > 0").collect()}
    got = Counter(r.doc_id for r in licenses.scan(docs).where("license = 'MIT-notice'").collect())
    assert set(got.items()) == want


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 65537])
def test_feistel_is_a_permutation(size):
    order = training_order.Feistel(size, 5)
    slots = order.forward(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (order.back(slots) == np.arange(size)).all()


def test_training_order_round_trip(spark, texts, tmp_path):
    all_texts = ODD + texts
    docs = odd_docs(spark, all_texts)
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        manifest = training_order.write_shards(docs, f.read(), f"file://{tmp_path}")
    found = training_order.read_shards(manifest, f"file://{tmp_path}").collect()
    assert sorted(r.position for r in found) == list(range(len(found)))
    reference, parts = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for r in found:
        parts.setdefault(r.doc, {})[r.piece] = np.frombuffer(r.ids, "<u2").tolist()
    for i, text in enumerate(all_texts):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        assert sum((parts[i][k] for k in sorted(parts[i])), []) == ids
    later = training_order.read_shards(manifest, f"file://{tmp_path}", start=7).collect()
    assert {(r.position, r.doc, r.piece) for r in later} == {(r.position, r.doc, r.piece) for r in found if r.position >= 7}
    # Positions follow the Feistel slots of the indices, which count sequences in each scan partition from its base.
    bases, size, _ = training_order.plan(docs)
    order, slots = training_order.Feistel(size), {}
    where = {(r.p, r.doc_id) for r in docs.select(F.spark_partition_id().alias("p"), "doc_id").collect()}
    for p in {p for p, _ in where}:
        at = bases[p]
        for d in sorted(d for q, d in where if q == p):
            for k in sorted(parts[d]):
                slots[d, k] = int(order.forward(np.array([at]))[0])
                at += 1
    assert [(r.doc, r.piece) for r in sorted(found, key=lambda r: r.position)] == sorted(slots, key=slots.get)
    empty = training_order.write_shards(docs.limit(0), open(P.path("word_bpe_49k.json"), "rb").read(), f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_training_order_without_key_and_with_repeats(spark, tmp_path):
    rows = [(None, "a b"), (-1, "c"), (7, "same"), (7, "same"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        manifest = training_order.write_shards(docs, f.read(), f"{tmp_path}/plain")
    found = training_order.read_shards(manifest, f"{tmp_path}/plain").collect()
    assert sorted(-9 if r.doc is None else r.doc for r in found) == [-9, -9, -1, 7, 7]
    with pytest.raises(Exception):
        training_order.store_uri(spark, "nosuch://x/y")


def test_byte_bpe_of_one_very_long_text(spark):
    text = "A long text, with words and 12345 numbers; " * 60_000 + "z" * 5000
    ranks = byte_bpe.ranks_file()
    table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table_, special_tokens={})
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN), ranks).first()
    assert row.decoded == text.encode()
    assert bytes(row.ids) == np.array(reference.encode_ordinary(text), "<u4").tobytes()


def test_html_tables_and_visibility():
    assert html.extract("<table><tr><td><pre>a\n  b</pre><td><ul><li>x<li>y</ul></table>") == "a   | - x\n  b | - y"
    assert html.extract("<table><tr><td colspan=2>wide<td>z<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>") == "wide  | z\na | b | c\n  | d | e"
    assert html.extract("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert html.extract("<div style='visibility:hidden'>no <span style='visibility: visible'>yes</span></div>") == "yes"
    assert html.extract("<div style='display:none'>no <span style='visibility: visible'>no</span></div>") == ""
    assert html.extract("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>") == "S\nT\nyes"
    assert html.extract("<dialog>no</dialog><dialog open>d</dialog>") == "d"
    assert html.extract("<table><tr><td>" * 40 + "deep" + "</table>" * 40) == "deep"
    assert html.extract("<table><tr><td>" * 2000 + "deep" + "</table>" * 2000) == "deep"
    assert html.extract("<input type=submit value=Go> <input type=hidden value=no>x") == "Go x"
    long = html.extract("<table>" + "<tr><td>cell<td>other" * 50_000 + "</table>" + "<p>word " * 50_000)
    assert long.count("cell | other") == 50_000 and long.count("word") == 50_000


def test_html_of_repeated_urls_and_clashing_names(spark):
    rows = [(1, "u", "<p>x</p>", "c"), (1, "u", "<p>y</p>", "c"), (None, None, "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in html.extract_text(pages, carry=("url",)).collect()) == [(0, "", ""), (1, "u", "x"), (1, "u", "y")]


def test_html_keeps_all_visible_text():
    """Open heads, strings and forms in tables, tables in tables, form fields, SVG and aria-hidden."""
    assert html.extract("<html><head><title>T</title><h1>Hi</h1><p>text") == "Hi\n\ntext"
    assert html.extract("<head><meta charset=x><script>s</script>\nplain") == "plain"
    assert html.extract("<head><noscript><p>n</p></noscript><style>p{}</style></head>x") == "x"
    assert html.extract("<table>loose<tr><form><td>x</td></form><td>y</td></tr></table>") == "loose\n\nx | y"
    assert html.extract("<table><tr><td>a</td>b<div>c</div></tr><td>d<td>e</table>") == "b\nc\n\na\nd | e"
    assert html.extract("<table><tr><td>a</td></tr><table><tr><td>b</td></tr></table></table>") == "a\n\nb"
    assert html.extract("<p>a <span aria-hidden=true>b</span></p>") == "a b"
    assert html.extract("<select><option>one<option>two</select><textarea>x\n y</textarea>") == "one two\nx\n y"
    assert html.extract("<svg><title>t</title><defs><text>d</text></defs><text>a</text> z <text>b</text></svg>") == "a b"
    assert html.extract("<table><tr>" + "<div>" * 5000 + "<td>x</td>" + "</div>" * 5000 + "</table>") == "x"


def test_pieces_are_numbered_without_a_call_of_python_each():
    """A dictionary's own factory numbers new pieces, and words of letters only are merged without another list each."""
    assert "__missing__" not in vars(bpe._Index)
    index = bpe._Index()
    assert [index[x] for x in ("a", "b", "a", "c")] == [0, 1, 0, 2] and index.since(1) == ["b", "c"]
