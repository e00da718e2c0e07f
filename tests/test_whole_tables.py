"""Queries that once read a subset of the ids give results for every row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillbar.plans.registry import QUERIES
from quillbar.sources.fixtures import bars, load

WHOLE = [
    ("decimal_text_all", ["l_orderkey", "l_linenumber"], "lineitem", ["l_orderkey", "l_linenumber"]),
    ("json_rows_all", ["o_orderkey"], "orders", ["o_orderkey"]),
    ("interval_join_all", ["span_id"], "events", ["event_id"]),
    ("path_extremes_all", ["claim_id"], "events", ["event_id"]),
    ("settle", ["claim_id"], "events", ["event_id"]),
    ("watch_stream", ["watch_id"], "events", ["event_id"]),
]


@pytest.mark.parametrize(("name", "key", "source", "of"), WHOLE)
def test_every_row_has_its_result(spark, sf, name, key, source, of):
    got = {tuple(int(x) for x in r) for r in QUERIES[name](spark, sf).select(*key).collect()}
    assert got == {tuple(r) for r in load(spark, sf, source).select(*of).collect()}


def test_triggers_are_sought_for_every_event(spark, sf):
    got = {r.claim_id for r in QUERIES["trigger_search_all"](spark, sf).select("claim_id").collect()}
    assert {i % 10 for i in got} == set(range(10))


def test_watches_see_ticks_of_any_date(spark, sf, tmp_path):
    load(spark, sf, "events").where("event_id % 20 = 0").withColumn("ts", F.col("ts") + F.expr("interval 400 days")).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["watch_stream"](spark, f"file://{tmp_path}").collect()
    assert len(got) == 50 and all(r.error is None for r in got)


def test_baseline_has_samples_of_250_days(spark, sf):
    """Every event's samples, 1 to 250 days before it, counted one by one."""
    hour, day = dt.timedelta(hours=1), dt.timedelta(days=1)
    closes = {(r.symbol, r.end): r.close for r in bars(spark, sf).collect()}
    want = {}
    for e in load(spark, sf, "events").select("event_id", "event_type", "ts").collect():
        at = e.ts.replace(minute=0, second=0, microsecond=0)
        for k in range(1, 251):
            base, last = (closes.get((e.event_type, at - k * day + x * hour)) for x in (0, 6))
            if base is not None and last is not None:
                n, wins = want.get(e.event_id, (0, 0))
                want[e.event_id] = (n + 1, wins + (last - base >= base * 0.05))
    assert {r.claim_id: (r.n, r.wins) for r in QUERIES["baseline_rate"](spark, sf).collect()} == want
