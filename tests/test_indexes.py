"""The stored indexes of texts and of vectors against scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbar.functions.text import contains_literal
from quillbar.operators import shapes, text_index, vector_index


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    words = ["alpha", "Beta", "100%", "a_b", "c\\d", "Größe", "字符串", "naïve", "x"] + [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[j] for j in rng.integers(0, len(words), rng.integers(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "alpha beta"), (1002, "%"), (3, "alpha again"), (1003, "y" * 300_000 + " needle in it"), (1004, "İstanbul")]
    docs = spark.createDataFrame(rows, "key long, text string").repartition(6)
    path = f"file://{tmp_path_factory.mktemp('grams')}"
    text_index.add(docs.where("coalesce(key, 0) % 3 > 0"), path, "key", "text")
    text_index.add(docs.where("coalesce(key, 0) % 3 = 0"), path, "key", "text")
    return docs, path


@pytest.mark.parametrize("phrase", ["a", "X", "%", "_", "\\", "字", "字符", "字符串", "größe", "ALPHA", "alpha beta", "100%", "a_b c", "c\\d", "needle in it", "nothing like it", "zq", "w17 w", "İ", "i̇s", "", "y" * 50])
def test_an_index_finds_what_a_scan_finds(texts, phrase):
    docs, path = texts
    want = docs.where(contains_literal(F.col("text"), F.lit(phrase))).where(F.col("key").isNotNull() | F.lit(not phrase))
    got = text_index.search(docs, path, phrase, "key", "text")
    rows = lambda df: sorted((r.key is None, r.key or 0, r.text) for r in df.collect())
    assert rows(got) == rows(want)


def test_a_search_reads_the_folders_of_its_grams(spark, texts):
    _, path = texts
    count = lambda df: len({r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()})
    every = count(spark.read.parquet(f"{path}/grams"))
    assert 0 < count(text_index.postings(spark, path, text_index.wanted("needle"))) <= every / 4
    plan = text_index.postings(spark, path, ["nee"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram,nee)" in plan


def test_postings_come_back():
    for keys in ([5], [0, 1, 2], [-9, 4, 300, 70_000, 1 << 40], list(range(0, 1 << 20, 999))):
        assert text_index.unpacked(text_index.packed(np.array(keys, np.int64))).tolist() == keys


def rows_of(spark, n=3000):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(30, 20))
    data = middles[rng.integers(0, 30, n)] + 0.6 * rng.normal(size=(n, 20))
    rows = [(i, [float(x) for x in v], "m", f"M{i % 4}", f"S{i % 7}", i) for i, v in enumerate(data)]
    rows += [(n, [0.0] * 20, "m", "M0", "S0", n), (n + 1, None, "m", "M0", "S0", n), (n + 2, [1.0] * 6, "small", "M0", None, 1), (n + 3, rows[5][1], "m", "M1", "S5", n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, model string, market string, symbol string, end long")


@pytest.mark.parametrize("pool", [200, 5000])
def test_vector_index_under_filters(spark, tmp_path, pool):
    """All filters, rows appended in blocks, a model without rows; exact where the pool holds all rows, recall above 0.95 where not."""
    rows, path = rows_of(spark), f"file://{tmp_path}/v"
    vector_index.create(rows.where("id < 2000"), path)
    vector_index.add(rows.where("id < 1500"), path)
    vector_index.add(rows.where("id >= 1500"), path)
    some = rows.where("id % 60 = 5 and embedding is not null and model = 'm'")
    none = F.lit(None).cast("string")
    kinds = [(none, none, F.lit(None)), (F.col("market"), none, F.lit(None)), (none, F.col("symbol"), F.lit(2500)), (F.col("market"), F.col("symbol"), F.lit(900))]
    asked = [some.select(F.concat_ws(":", F.lit(n), "id").alias("query_id"), "embedding", "model", m.alias("market"), s.alias("symbol"), c.cast("long").alias("cutoff"), F.array("id").alias("excluded")) for n, (m, s, c) in enumerate(kinds)]
    asked = asked[0].unionByName(asked[1]).unionByName(asked[2]).unionByName(asked[3])
    strange = asked.limit(1).withColumn("model", F.lit("unknown")).withColumn("query_id", F.lit("unknown"))
    got = {}
    for r in vector_index.search(asked.unionByName(strange), path, 20, pool=pool).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, round(r.distance, 9))
    want = {}
    for r in shapes.nearest_of_many(rows, asked, 20).collect():
        want.setdefault(r.query_id, {})[r.rank] = (r.id, round(r.distance, 9))
    assert got.keys() == want.keys()
    if pool > 3000:
        assert got == want
    else:
        found = sum(len({i for i, _ in got[q].values()} & {i for i, _ in want[q].values()}) for q in want)
        assert found >= 0.95 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(want[q]) for q in want)


def test_codes_lie_near_their_vectors():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(3000, 10))
    book = vector_index.Book.fitted(data, 3000)
    lists, codes = book.coded(data)
    assert codes.shape == (3000, 5) and codes.dtype == np.uint8 and lists.max() < len(book.lists)
    query = vector_index.unit(rng.normal(size=(1, 10)))[0]
    centre, words = book.table(query)
    guess = centre[lists] + words[np.arange(5)[None, :], codes].sum(1)
    assert np.abs(guess - vector_index.unit(data) @ query).mean() < 0.08
