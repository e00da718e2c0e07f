"""Queries without SQL against plain versions over a whole test table."""

from bisect import bisect_left, bisect_right
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd

from quillbar.operators import shapes
from quillbar.plans.registry import QUERIES
from quillbar.sources.fixtures import fills


def bars_of(sf, rule):
    e = pd.read_parquet(f"{sf}/events.parquet").sort_values(["ts", "event_id"])
    e["start"] = e["ts"].dt.floor(rule)
    g = e.groupby(["event_type", "start"])["value"]
    return pd.DataFrame({"open": g.first(), "high": g.max(), "low": g.min(), "close": g.last()}).reset_index()


def test_chunks_of_every_document(spark, sf):
    """Cuts by character edges: 480 bytes at most, 96 in common."""
    got = {}
    for r in QUERIES["utf8_chunks"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.text))
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        want, text = [], text or ""
        edges = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(int).tolist()
        at = 0
        while at < edges[-1]:
            end = edges[bisect_right(edges, at + 480) - 1]
            want.append((at, end, text[edges.index(at) : edges.index(end)]))
            if end == edges[-1]:
                break
            at = edges[bisect_left(edges, max(end - 96, at + 1))]
        assert sorted(got.get(doc, [])) == want


def test_settlement_range_of_every_symbol(spark, sf):
    """Mean of the first 14 true ranges, then Wilder's smoothing, with sixty digits."""
    got = {r.symbol: r.atr14 for r in QUERIES["atr14_settlement"](spark, sf).collect()}
    bars = bars_of(sf, "1D")
    bars = bars[bars["start"] + pd.Timedelta(days=1) <= pd.Timestamp("2024-01-25")]
    with localcontext() as ctx:
        ctx.prec = 60
        for symbol, part in bars.groupby("event_type"):
            rows = [tuple(Decimal(str(x)) for x in r) for r in part.tail(121)[["high", "low", "close"]].itertuples(index=False)]
            ranges = [max(h - low, abs(h - before[2]), abs(low - before[2])) for before, (h, low, _) in zip(rows, rows[1:], strict=False)]
            value = sum(ranges[:14]) / 14
            for x in ranges[14:]:
                value = (value * 13 + x) / 14
            assert Decimal(got[symbol]) == value.quantize(Decimal("1E-12"))
    assert set(got) == set(bars["event_type"])


def test_windows_of_every_symbol(spark, sf):
    """Every window of 64 bars without holes, sixteen bars apart, with the descriptor of its bars."""
    got = {(r.symbol, pd.Timestamp(r.start)): (pd.Timestamp(r.end), r.embedding) for r in QUERIES["window_index"](spark, sf).collect()}
    hour, want = pd.Timedelta(hours=1), {}
    for symbol, part in bars_of(sf, "1h").groupby("event_type"):
        start, ohlc = part["start"].to_list(), part[["open", "high", "low", "close"]].to_numpy()
        for at in range(0, len(part) - 63, 16):
            if start[at + 63] - start[at] == 63 * hour:
                try:
                    want[symbol, start[at]] = start[at + 63] + hour, shapes.descriptor(ohlc[at : at + 64])
                except ValueError:
                    continue
    assert got.keys() == want.keys()
    assert all(got[k][0] == end and np.allclose(got[k][1], v, atol=1e-6) for k, (end, v) in want.items())


def test_positions_of_every_book(spark, sf):
    """Cycles of average cost, in exact fractions."""
    want, books = {}, {}
    for r in fills(spark, sf).collect():
        books.setdefault(r.symbol, []).append((r.at, r.trade_id, r.side, Fraction(r.price), Fraction(r.quantity), Fraction(r.fee)))
    for symbol, rows in books.items():
        held, cost, pnl, fees, ordinal, opened, sign = Fraction(0), None, Fraction(0), Fraction(0), 0, None, 0
        for at, _, side, price, quantity, fee in sorted(rows):
            way, left = (1 if side == "BUY" else -1), quantity
            if held and sign != way:
                closed = min(quantity, held)
                pnl += closed * (price - cost) * sign
                fees += fee * closed / quantity
                held, left = held - closed, quantity - closed
                if not held:
                    want[symbol, ordinal] = ("long" if sign > 0 else "short", opened, at, pnl, fees, "closed")
                    pnl, fees, ordinal = Fraction(0), Fraction(0), ordinal + 1
            if left:
                cost = price if not held else (held * cost + left * price) / (held + left)
                sign, opened = (way, at) if not held else (sign, opened)
                held, fees = held + left, fees + fee * left / quantity
        if held:
            want[symbol, ordinal] = ("long" if sign > 0 else "short", opened, None, pnl, fees, "open")
    got = {(r.symbol, r.ordinal): r for r in QUERIES["positions"](spark, sf).collect()}
    first = min(k[1] for k in got)
    assert {(s, n - first) for s, n in got} == want.keys() and len(want) > 100
    for (symbol, ordinal), (direction, opened, closed, pnl, fees, status) in want.items():
        r = got[symbol, ordinal + first]
        assert (r.direction, r.opened_at, r.closed_at, r.status) == (direction, opened, closed, status)
        assert abs(Fraction(r.pnl) - pnl) < Fraction(1, 10**20) and abs(Fraction(r.fees) - fees) < Fraction(1, 10**20)
