"""Ordered searches, extremes of trades and settlement by columns, against plain versions."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillbar.operators import ordered, rules

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_maxima_answer_like_a_scan(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 50, n).astype(float)
    tree = ordered.Maxima(values)
    start, least = rng.integers(0, n + 1, 300), rng.integers(0, 55, 300).astype(float)
    want = [next((i for i in range(s, n) if values[i] >= x), n) for s, x in zip(start, least, strict=True)]
    assert tree.first(start, least).tolist() == want
    lo = rng.integers(0, n, 300)
    hi = np.array([rng.integers(x + 1, n + 1) for x in lo])
    assert tree.greatest(lo, hi).tolist() == [values[a:b].max() for a, b in zip(lo, hi, strict=True)]


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_searches_do_not_depend_on_batches(size):
    """Questions wait across batches; equal times, NaN and questions without an answer are met."""
    rng = np.random.default_rng(5)
    points = sorted((int(rng.integers(0, 400)), i, float(rng.choice([1, 5, 9, np.nan, 3]))) for i in range(300))
    asked = [(int(rng.integers(0, 400)), q, int(rng.integers(0, 450)), float(rng.choice([0, 5, 9, 10])), bool(rng.random() < 0.5)) for q in range(200)]
    rows = [(at, False, i, p, 0, 0, 0.0, False) for at, i, p in points] + [(at, True, 0, 0.0, q, hi, level, up) for at, q, hi, level, up in asked if at < hi]
    table = pd.DataFrame(sorted(rows, key=lambda r: r[:3]), columns=["at", "asks", "point_id", "price", "question", "hi", "level", "up"])
    fold, found = ordered._FirstReach(), []
    for lo in range(0, len(table), size):
        out = fold.push(table.iloc[lo : lo + size])
        found += [] if out is None else list(map(tuple, out[["question", "at", "point_id"]].to_numpy().tolist()))
    reached = lambda p, level, up: (np.isnan(p) or p >= level) if up else p <= level
    want = [(q, *next(((a, i) for a, i, p in points if at < a <= hi and reached(p, level, up)), (None, None))) for at, q, hi, level, up in asked]
    assert sorted(found) == sorted(x for x in want if x[1] is not None)
    fold, found = ordered._Extremes(), []
    numbers = table[~table["price"].isna()]
    for lo in range(0, len(numbers), size):
        found.append(fold.push(numbers.iloc[lo : lo + size]))
    got = pd.concat([x for x in [*found, fold.done()] if x is not None])
    want = {}
    for at, q, hi, _, _ in asked:
        if inside := [p for a, _, p in points if at < a <= hi and p == p]:
            want[q] = (max(inside), min(inside))
    assert {int(r.question): (r.most, r.least) for r in got.itertuples()} == want


def test_traded_extremes_equal_a_plain_reduction(spark):
    rng = np.random.default_rng(12)
    ticks = [("ab"[i % 2], T0 + dt.timedelta(microseconds=int(x)), float(rng.integers(1, 900))) for i, x in enumerate(sorted(rng.integers(0, 6 * 86_400_000_000, 1500)))]
    ticks += [("a", T0 + dt.timedelta(hours=h), float(h)) for h in range(60)] + [("a", T0, None)]
    claims = []
    for i in range(150):
        start = T0 + dt.timedelta(hours=int(rng.integers(0, 100)), seconds=int(rng.integers(0, 3)) * 600)
        claims.append((f"c{i}", "abz"[i % 3], start, start + dt.timedelta(minutes=int(rng.choice([0, 3, 60, 600, 1440, 4000])))))
    df = spark.createDataFrame(claims, "claim_id string, symbol string, start timestamp_ntz, through timestamp_ntz")
    got = {r.claim_id: (r.most, r.least) for r in rules.traded(df, spark.createDataFrame(ticks, "symbol string, at timestamp_ntz, price double")).collect()}
    want = {}
    for c, symbol, start, through in claims:
        if inside := [p for s, at, p in ticks if s == symbol and start < at <= through and p is not None]:
            want[c] = (max(inside), min(inside))
    assert got == want and len(want) > 50


def test_searches_have_no_join_of_claims_and_points(spark, sf):
    from quillbar.plans.registry import QUERIES

    plan = QUERIES["trigger_search"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "MapInPandas" in plan  # claims meet extremes of days


def test_settlement_by_columns_equals_the_function(spark):
    """Every branch, half-way ratios, long decimals and broken numbers."""
    rnd = random.Random(4)
    number = lambda: rnd.choice(["100", "99.5", "0.000003", "3", "7", "100.123456", "8000000000", "33.3333333333", "123456789012345.5"])
    rows = []
    for i in range(900):
        template = rnd.choice(["T0", "T1", "T1", "T2", "T3", "T4", "T5"])
        trio = sorted((number() for _ in range(3)), key=float)
        if rnd.random() < 0.1:
            trio = [rnd.choice(["0", "-1", "5"]) for _ in range(3)]
        by_ratio = rnd.random() < 0.5
        criteria = {
            "version": rnd.choice(["criteria-v1"] * 9 + ["x"]), "template": template, "selected_by": "explicit", "direction": rnd.choice(["L", "S", "S", None]),
            "horizon_hours": rnd.choice([1, 24]), "threshold_ratio": rnd.choice(["0.05", "0.333333", "1"]) if by_ratio else None, "atr_multiple": None if by_ratio else rnd.choice(["2", "1.25", None]),
            "invalidation": rnd.choice([None, None, None, "90", "99999999999"]), "boundary": rnd.choice(["3", "100"]), "boundary_kind": rnd.choice(["lower_floor", "upper_ceiling"]),
            "trigger": {"kind": "trade_touch", "comparator": "gte", "price": "5", "window_hours": 3, "interval_seconds": None},
        }
        end = T0 + dt.timedelta(hours=rnd.choice([-1, 0, 5, 24, 30]))
        rows.append((i, criteria, T0, end, trio[1], trio[2], trio[0], rnd.choice(["5", "1.5", None, "0"]), rnd.choice([number(), None, "0", "-3"]), rnd.random() < 0.9, rnd.random() < 0.9))
    df = spark.createDataFrame(rows, f"claim_id long, criteria {rules.CRITERIA}, start timestamp_ntz, evaluated_at timestamp_ntz, base string, highest string, lowest string, atr string, end_price string, covered boolean, endpoint_proven boolean")
    codes = {r.claim_id: r.code for r in df.select("claim_id", rules.error_code(F.col("criteria")).alias("code")).collect()}
    got = {r.claim_id: tuple(r)[1:] for r in rules.settle(df).collect()}
    for i, c, start, end, base, high, low, atr, price, covered, proven in rows:
        if codes[i]:
            assert got[i] == ("no_criteria", codes[i], None, None, None)
            continue
        want = rules.verdict(rules.Reduced(c, start, end, base, high, low, covered, proven, atr, price))
        assert got[i] == tuple(want[n] for n in ("state", "reason", "mfe", "mae", "signed_return")), rows[i]
    assert len({(x[0], x[1]) for x in got.values()}) > 12
