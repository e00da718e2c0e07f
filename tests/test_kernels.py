"""Golden values of the pure kernels."""

import datetime as dt
from decimal import Decimal as D

import numpy as np
import pytest

from quillbar.functions import interval
from quillbar.functions.decimals import dec, fmt, plain, ratio, times
from quillbar.functions.text import _cuts
from quillbar.operators import shapes
from quillbar.operators.ledger import Book
from quillbar.operators.rules import Reduced, levels, verdict
from quillbar.streaming.watch import Watch

T0 = dt.datetime(2024, 1, 1)


def rule(template="T1", **given):
    return {"version": "criteria-v1", "template": template, "selected_by": "explicit", "direction": "L", "horizon_hours": 2} | given


def reduced(c, **given):
    base = {"start": T0, "evaluated_at": T0 + dt.timedelta(hours=2), "base": "100", "highest": "104", "lowest": "99", "covered": True, "endpoint_proven": True, "atr": "2", "end_price": "102"}
    return Reduced(c, **(base | given))


def test_decimals():
    assert fmt(D("1.0000000000005")) == "1" and fmt(D("1.0000000000015")) == "1.000000000002"
    assert str(ratio(D(1), D(3))) == "0." + "3" * 34
    assert times(D("1" + "0" * 20 + "1"), D("1" + "0" * 20 + "1")) == D("1.000000000000000000002E+42")
    assert plain(D("1E+3")) == "1000" and plain(D("-0.00")) == "0" and plain(D("2.50")) == "2.5"
    for bad in ("x", "9" * 97, "1E+70", "NaN", None):
        with pytest.raises(ValueError):
            dec(bad)


def test_verdict_order():
    assert verdict(reduced(rule()))["state"] == "realized"  # 2 gained, 1 ATR asked
    assert verdict(reduced(rule(), end_price="101.9")) == {"state": "unrealized", "reason": "window_completed", "mfe": "0.04", "mae": "-0.01", "signed_return": "0.019"}
    assert verdict(reduced(rule(), evaluated_at=T0 + dt.timedelta(hours=1)))["state"] == "pending"
    assert verdict(reduced(rule(), covered=False))["reason"] == "path_coverage_unproven"
    touched = verdict(reduced(rule("T2", invalidation="99"), covered=False))
    assert (touched["state"], touched["reason"]) == ("unrealized", "boundary_or_invalidation_touched")
    assert verdict(reduced(rule(), atr=None))["reason"] == "atr_missing"
    assert verdict(reduced(rule(), endpoint_proven=False))["reason"] == "endpoint_unproven"
    assert verdict(reduced(rule("T4", boundary="98", boundary_kind="lower_floor")))["state"] == "realized"
    assert verdict(reduced(rule("T5")))["state"] == "realized" and verdict(reduced(rule("T5", atr_multiple="3")))["state"] == "unrealized"
    assert verdict(reduced(rule(direction="S"), end_price="98", lowest="98"))["state"] == "realized"
    assert verdict(reduced(rule("T0")))["state"] == "no_criteria"


def test_levels_agree_with_the_verdict():
    found = levels(rule(threshold_ratio="0.025"), "100", None)
    assert (found["threshold"], found["target"]) == ("2.5", "102.5")
    assert levels(rule(direction="S", atr_multiple="1.5"), "200", "3.2")["target"] == "195.2"
    assert levels(rule("T3", threshold_ratio="0.02"), "111", None)["target"] == "113.22"


def test_reversal_splits_a_fill():
    book = Book(D(0))
    book.fill(1, 1, "BUY", D(100), D(2), D(".2"), D(0))
    book.fill(2, 2, "SELL", D(110), D(3), D(".3"), D(20))
    assert book.quantity == -1
    book.fill(3, 3, "BUY", D(105), D(1), D(".1"), D(5))
    assert [(o, pnl, fees) for o, _, _, _, pnl, fees, _, _ in book.cycles] == [(0, D(20), D(".4")), (1, D(5), D(".2"))]
    assert [a[2] for a in book.allocations] == ["open", "close", "open", "close"]


def test_books_refuse_and_invent_nothing():
    book = Book(D(0), hedge=1)
    book.fill(1, 1, "BUY", D(100), D(1), D(0))
    with pytest.raises(ValueError, match="hedge_over_close"):
        book.fill(2, 2, "SELL", D(100), D(2), D(0))
    with pytest.raises(ValueError, match="fill_order_unproven"):
        book.fill(1, 1, "BUY", D(100), D(1), D(0))
    unknown = Book(None)
    unknown.fill(1, 1, "SELL", D(100), D(1), D(".5"))
    assert unknown.cycles == [] and unknown.unknown == 1 and unknown.fees == D(".5")
    inverse = Book(D(0), inverse=True, multiplier=D(10))
    inverse.fill(1, 1, "BUY", D(100), D(1), D(0))
    inverse.fill(2, 2, "SELL", D(125), D(1), D(0))
    assert inverse.cycles[0][4] == D("0.02")


@pytest.mark.parametrize(("name", "at", "floor"), [
    ("3d", "2023-08-16", "2023-08-16"), ("3d", "2023-08-18 23:59", "2023-08-16"), ("3d", "2023-08-15", "2023-08-14"), ("3d", "2026-01-02", "2026-01-02"), ("3d", "2022-12-31", "2022-12-29"),
    ("1w", "2024-01-07 12:00", "2024-01-01"), ("1w", "1969-12-30", "1969-12-29"), ("1M", "2024-02-29 05:00", "2024-02-01"), ("15m", "2024-01-01 00:29:59", "2024-01-01 00:15"), ("4h", "1969-12-31 23:00", "1969-12-31 20:00"),
])
def test_interval_grids(name, at, floor):
    assert interval.floor_value(dt.datetime.fromisoformat(at), name) == dt.datetime.fromisoformat(floor)


def test_interval_names():
    assert interval.parse("1M") == "1M" and interval.parse("1m") == "1m" and interval.parse("Daily") == "1d" and interval.parse("60M") == "1h"
    assert interval.from_seconds(900) == "15m" and interval.folder("1M") == "1mo" and interval.LEAST_SECONDS["1M"] == 28 * 86400
    with pytest.raises(ValueError):
        interval.parse("7x")


def candles(sign=1, scale=1.0):
    v = 100 + scale * sign * (0.8 * np.arange(64) + 5 * np.sin(0.4 * np.arange(64)))
    return np.stack([v, v + 2 * scale, v - scale, v + 0.5 * scale], 1)


def test_shapes_score_by_form():
    a = shapes.normalize(candles())
    assert shapes.warped(a, shapes.normalize(candles() * 3 + 7)) > 0.999
    assert shapes.warped(a, shapes.normalize(candles(-1))) < 0.4
    assert shapes.warped(a, shapes.normalize(candles(-1), reverse=True)) > 0.8
    assert shapes.same_direction(a, a) and abs(np.linalg.norm(shapes.descriptor(candles())) - 1) < 1e-6
    with pytest.raises(ValueError, match="flat"):
        shapes.normalize(np.full((20, 4), 5.0))
    with pytest.raises(ValueError, match="invalid"):
        shapes.normalize(candles()[:10])
    assert shapes.priced(candles(), candles()) == 1.0 and shapes.priced(candles(), candles() * 1.05) < 0.01


def test_sweep_finds_its_own_excerpt():
    x = np.arange(160)
    v = 100 + 8 * np.sin(x / 9) + 5 * np.sin(x / 3.7) + 0.05 * x
    series = np.stack([v, v + 1, v - 1, v + 0.2], 1)
    score, start, length = shapes.sweep(series[60:92], series, 30, 34, 2)[0]
    assert abs(start - 60) <= 2 and abs(length - 32) <= 4 and score > 0.9


def test_recall_finds_an_excerpt_of_another_length():
    x = np.arange(128)
    v = 100 + 12 * np.sin(x / 11) + 6 * np.sin(x / 5)
    series = np.stack([v, v + 1.5, v - 1.5, v + 0.4], 1)
    query, indexed = shapes.descriptor(series[10:118]), shapes.descriptor(series)
    assert shapes.recall_distance(query, indexed, 108, 128) < 0.055
    assert abs(shapes.recall_distance(query, shapes.descriptor(series * 4), 108, 128) - shapes.recall_distance(query, indexed, 108, 128)) < 1e-4
    assert shapes.recall_distance(query[:10], indexed, 108, 128) == float("inf")


def test_chunks_cut_between_characters():
    text = "é漢🙂a" * 200
    cuts = _cuts(text)
    raw = text.encode()
    assert all(raw[a:b].decode() == t and b - a <= 480 for a, b, t in cuts)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(raw) and all(x[1] > y[0] for x, y in zip(cuts, cuts[1:], strict=False))


def test_watch_equals_batch_and_refuses_gaps():
    us = lambda h: int(h * 3_600_000_000)
    c = rule(threshold_ratio="0.02")
    rows = [(us(0.5), 1, "103"), (us(1), 2, "99"), (us(2), 3, "102")]
    for cut in range(1, 4):
        watch = Watch.begin(c, 0, "100")
        edges = [0, *(at for at, _, _ in rows[:cut]), us(2)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                watch.trades(a, b, [r for r in rows if a < r[0] <= b])
        assert watch.result("102", True) == verdict(Reduced(c, dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 1, 2), "100", "103", "99", True, True, None, "102"))
    watch = Watch.begin(c, 0, "100")
    watch.trade(us(0.1), 5, "100")
    for number, code in ((7, "trade_id_gap"), (5, "trade_order_unproven")):
        with pytest.raises(ValueError, match=code):
            watch.trade(us(0.2), number, "100")
    with pytest.raises(ValueError, match="not_contiguous"):
        watch.trades(us(0.5), us(1), [])


def test_watch_waits_for_its_trigger():
    us = lambda h: int(h * 3_600_000_000)
    c = rule("T3", horizon_hours=1, threshold_ratio="0.05", trigger={"kind": "bar_close", "comparator": "gte", "price": "105", "window_hours": 2, "interval_seconds": 3600})
    watch = Watch.begin(c, 0, "100")
    watch.bars(0, us(1), [(0, us(1), "100", "104", "99", "103")])
    assert watch.result(None, False)["state"] == "pending"
    watch.bars(us(1), us(2), [(us(1), us(2), "103", "107", "103", "106")])
    assert watch.start == us(2) and watch.base == "106" and watch.deadline() == us(3)
    missed = Watch.begin(c, 0, "100")
    missed.bars(0, us(2), [(0, us(1), "100", "104", "99", "103"), (us(1), us(2), "103", "104", "99", "100")])
    assert missed.result(None, False)["state"] == "not_triggered"
