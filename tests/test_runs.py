"""Frozen runs and their pages."""

import pytest
from pyspark.sql import functions as F

from quillbar.operators import runs


def rows(spark, n, last):
    return spark.range(n).select("id", (F.col("id") * 7919 % 101).alias("score"), F.lit(last).cast("long").alias("closed_at"))


def test_pages_stay_as_they_are(spark, tmp_path):
    path, filters, order = f"file://{tmp_path}/r", {"a": 1, "b": "x"}, [F.desc("score"), "id"]
    with pytest.raises(ValueError, match="run_missing"):
        runs.page(spark, path, filters, 10)
    with pytest.raises(ValueError, match="epoch_not_closed"):
        runs.freeze(rows(spark, 5, 100), path, "one", order, filters, 99)
    assert runs.manifest(spark, path) is None
    made = runs.freeze(rows(spark, 95, 100), path, "one", order, filters, 100)
    assert made["rows"] == 95 and runs.freeze(rows(spark, 3, 100), path, "one", order, filters, 100) == made
    with pytest.raises(ValueError, match="run_is_frozen"):
        runs.freeze(rows(spark, 3, 100), path, "one", order, filters, 200)

    def pages(cursor=None, size=20, name=filters):
        out = []
        while True:
            found, cursor = runs.page(spark, path, name, size, cursor)
            out.append([r.id for r in found.collect()])
            if cursor is None:
                return out

    before = pages()
    assert [len(p) for p in before] == [20, 20, 20, 20, 15]
    assert sum(before, []) == [r.id for r in rows(spark, 95, 1).orderBy(*order).collect()]
    _, cursor = runs.page(spark, path, filters, 20)
    runs.freeze(rows(spark, 200, 150), path, "two", order, {"b": "x", "a": 1}, 150)
    assert pages(cursor) == before[1:]  # those of the earlier run
    assert sum(map(len, pages())) == 200  # a new reader meets the later one
    with pytest.raises(ValueError, match="cursor_mismatch"):
        runs.page(spark, path, {"a": 2, "b": "x"}, 20, cursor)
    with pytest.raises(ValueError, match="cursor_invalid"):
        runs.page(spark, path, filters, 20, "no cursor")


def test_a_run_that_did_not_end_is_not_there(spark, tmp_path):
    path, filters = f"file://{tmp_path}/r", {}
    rows(spark, 10, 1).withColumn("place", F.col("id") + 1).write.parquet(f"{path}/rows/half")
    assert runs.manifest(spark, path, "half") is None
    assert runs.freeze(rows(spark, 12, 1), path, "half", ["id"], filters, 5)["rows"] == 12
    assert runs.page(spark, path, filters, 100)[0].count() == 12


def test_an_empty_run_has_one_empty_page(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    assert runs.freeze(rows(spark, 0, 1), path, "none", ["id"], {}, 5)["rows"] == 0
    found, cursor = runs.page(spark, path, {}, 10)
    assert found.count() == 0 and cursor is None
