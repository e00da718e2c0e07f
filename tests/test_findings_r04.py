"""What the findings of the fourth review were about."""

import pytest
from pyspark.sql import functions as F

from quillbar.operators import relational
from quillbar.plans.registry import QUERIES
from quillbar.sources.fixtures import load
from tests.test_findings_r03 import same_as_sql

NAMES = pytest.mark.parametrize("name", ["interval_join", "interval_join_all"])


@NAMES
def test_written_pairs_take_few_bits(spark, tmp_path, name):
    """Two million pairs of points and spans that crowd in one slot; 1.4 bytes each before."""
    ts = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 7919 % 3000)).cast("timestamp_ntz")
    events = spark.range(3000).select((F.col("id") * 1_000_003 % 100_000).alias("event_id"), ts.alias("ts"), F.element_at(F.array(F.lit("view"), F.lit("click")), (F.col("id") % 2 + 1).cast("int")).alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    QUERIES[name](spark, f"file://{tmp_path}").write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"file://{tmp_path}/pairs").count()
    took = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert n > 2_000_000 and took < 0.4 * n


@NAMES
def test_chunks_and_parts_of_both_sides_lose_no_pair(spark, sf, tmp_path, monkeypatch, name):
    """Rows that repeat, times that tie at the bounds of spans, chunks and parts of a few rows."""
    monkeypatch.setattr(relational, "CHUNK", 3)
    monkeypatch.setattr(relational, "HELD", 5)
    events = load(spark, sf, "events").where("event_id < 300").withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    events.unionByName(events.withColumn("event_id", F.col("event_id") + 1000)).unionByName(events.where("event_id < 9")).write.parquet(f"{tmp_path}/events.parquet")
    assert same_as_sql(spark, tmp_path, name, ["events"])
