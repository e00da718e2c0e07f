"""Builds of the window index that take over unchanged blocks."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quillbar.operators import shapes, window_blocks

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def bars_of(spark, rows):
    return spark.createDataFrame([(s, T0 + n * HOUR, *map(float, x)) for s, n, x in rows], "symbol string, start timestamp_ntz, open double, high double, low double, close double")


def series(rng, n):
    close = 100 + np.cumsum(rng.normal(size=n))
    opened = np.concatenate([[100.0], close[:-1]])
    return np.stack([opened, np.maximum(opened, close) + 1, np.minimum(opened, close) - 1, close], 1)


def rows_of(found):
    return sorted((r.symbol, r.start, r.end, tuple(round(x, 6) for x in r.embedding)) for r in found.collect())


def test_a_second_build_reads_only_what_is_new(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(window_blocks, "BLOCK", 40)
    rng = np.random.default_rng(3)
    data = {s: series(rng, 400) for s in "ab"}
    holes = {("a", n) for n in (100, 101, 250)}
    rows = [(s, n, data[s][n]) for s in "ab" for n in range(400) if (s, n) not in holes]
    path, other = f"file://{tmp_path}/one", f"file://{tmp_path}/whole"
    early = [r for r in rows if r[1] < 230]
    first = window_blocks.build(bars_of(spark, early), path, 20, 4, 3600)
    assert first["reused"] == 0 and first["generation"] == 1
    second = window_blocks.build(bars_of(spark, rows), path, 20, 4, 3600)
    assert second["built"] < second["built"] + second["reused"] and second["reused"] >= 2 * 4
    again = window_blocks.build(bars_of(spark, rows).repartition(7), path, 20, 4, 3600)
    assert again["built"] == 0 and again["reused"] == second["built"] + second["reused"]
    window_blocks.build(bars_of(spark, rows), other, 20, 4, 3600)
    whole = rows_of(window_blocks.windows(spark, other, 20, 3600))
    assert rows_of(window_blocks.windows(spark, path, 20, 3600)) == whole
    assert rows_of(window_blocks.windows(spark, path, 20, 3600, 2)) == whole
    assert len(rows_of(window_blocks.windows(spark, path, 20, 3600, 1))) < len(whole)

    # The windows are those of a plain walk.
    grid = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600
    want = []
    for s in "ab":
        have = {n for x, n, _ in rows if x == s}
        for n in range(400):
            if (grid + n) % 4 == 0 and all(m in have for m in range(n, n + 20)):
                v = shapes.descriptor(data[s][n : n + 20])
                want.append((s, T0 + n * HOUR, T0 + (n + 20) * HOUR, tuple(round(float(x), 6) for x in v)))
    assert [x[:3] for x in whole] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in whole], [x[3] for x in sorted(want)], atol=2e-6)
    ranges = {(r.symbol, r.start, r.end) for r in window_blocks.coverage(window_blocks.windows(spark, path, 20, 3600)).collect()}
    assert len([r for r in ranges if r[0] == "a"]) == 3 and len([r for r in ranges if r[0] == "b"]) == 1


def test_a_changed_bar_changes_the_blocks_that_see_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(window_blocks, "BLOCK", 40)
    rng = np.random.default_rng(4)
    data = series(rng, 240)
    rows = [("a", n, data[n]) for n in range(240)]
    path = f"file://{tmp_path}/w"
    made = window_blocks.build(bars_of(spark, rows), path, 16, 1, 3600)
    rows[100] = ("a", 100, data[100] + [0, 5, 0, 0])
    second = window_blocks.build(bars_of(spark, rows), path, 16, 1, 3600)
    assert 1 <= second["built"] <= 2 and second["built"] + second["reused"] == made["built"]
    # A build without a manifest left files that nobody sees.
    before = rows_of(window_blocks.windows(spark, path, 16, 3600))
    spark.read.parquet(f"{path}/windows/generation=2").withColumn("number", F.col("number") + 1).write.parquet(f"{path}/windows/generation=3")
    assert rows_of(window_blocks.windows(spark, path, 16, 3600)) == before
    assert window_blocks.build(bars_of(spark, []), f"file://{tmp_path}/none", 16, 1, 3600) == {"generation": 1, "built": 0, "reused": 0}
