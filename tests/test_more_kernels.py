"""Folds, searches, chart geometry, digits, files and streams against plain versions."""

import datetime as dt
import io
import json
import zipfile
from decimal import Decimal as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillbar.functions import decimals, interval, text
from quillbar.operators import bars as B
from quillbar.operators import folds, ledger, relational, retrieval, rules, shapes, statistics
from quillbar.sources import files
from quillbar.sources.fixtures import bars, fills, load, resample
from quillbar.streaming import watch

T0 = dt.datetime(2024, 1, 1)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


def test_dense_numbers_follow_the_order(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, 500).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(7)
    got = {r.id: r.n for r in folds.numbered(df, [F.desc("v"), "id"], "n").collect()}
    assert got == {i: k + 1 for k, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)))}
    assert folds.numbered(df.limit(0), ["id"], "n").count() == 0


def test_folds_go_on_over_batches_and_null_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(k, i) for k in ("a", "b", None) for i in range(10)]
        df = spark.createDataFrame(rows, "k string, i long").repartition(3)

        class Sum:
            def __init__(self, key):
                self.key, self.total, self.parts = key[0], 0, 0

            def push(self, pdf):
                self.total, self.parts = self.total + int(pdf["i"].sum()), self.parts + 1

            def done(self):
                return pd.DataFrame([(self.key, self.total, self.parts)], columns=["k", "total", "parts"])

        got = {r.k: (r.total, r.parts >= 4) for r in folds.folded(df, ["k"], ["i"], Sum, "k string, total long, parts long").collect()}
        assert got == {"a": (45, True), "b": (45, True), None: (45, True)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_means_of_parts_are_those_of_the_whole():
    from quillbar.operators.indicators import RecursiveMean, recursive_mean

    rng = np.random.default_rng(1)
    values = np.where(rng.random(200) < 0.1, np.nan, rng.normal(size=200))
    whole, mean = recursive_mean(values, 12, 2 / 13), RecursiveMean(12, 2 / 13)
    parts = np.concatenate([mean.push(x) for x in np.split(values, [1, 5, 9, 40, 41, 150])])
    assert np.allclose(whole, parts, equal_nan=True, rtol=0, atol=0)
    known, plain, last = [], [], None
    for v in values:
        if np.isnan(v):
            plain.append(np.nan)
            continue
        known.append(v)
        if len(known) == 12:
            last = np.mean(known)
        elif last is not None:
            last = last + 2 / 13 * (v - last)
        plain.append(np.nan if last is None else last)
    assert np.allclose(whole, plain, equal_nan=True)


def test_a_resumed_book_is_the_whole_book():
    rng, moments = np.random.default_rng(5), [pd.Timestamp(T0) + pd.Timedelta(hours=i) for i in range(120)]
    trades = [(at, i + 1, ["BUY", "SELL"][int(rng.integers(2))], D(int(rng.integers(90, 110))), D(int(rng.integers(1, 5))), D(int(rng.integers(0, 9))) / 10, None, ["BNB", "USDT"][int(rng.integers(2))]) for i, at in enumerate(moments)]
    whole = ledger.Book()
    for x in trades:
        whole.fill(*x)
    for cut in (0, 1, 37, 119, 120):
        first = ledger.Book()
        for x in trades[:cut]:
            first.fill(*x)
        later = ledger.Book.resumed(first.checkpoint())
        for x in trades[cut:]:
            later.fill(*x)
        assert first.cycles + later.cycles == whole.cycles and first.paid + later.paid == whole.paid
        assert first.allocations + later.allocations == whole.allocations
        assert later.checkpoint() == whole.checkpoint()
    with pytest.raises(ValueError, match="protocol"):
        ledger.Book.resumed(json.dumps({"protocol": "other", "state": {}}))


def test_commissions_are_kept_by_asset():
    book = ledger.Book()
    book.fill(1, 1, "BUY", D(100), D(2), D(".2"), asset="USDT")
    book.fill(2, 2, "SELL", D(110), D(3), D(".3"), asset="BNB")
    assert book.paid == [{"USDT": D(".2"), "BNB": D(".2")}] and book.commissions == {"BNB": D(".1")}


def test_batches_advance_only_their_books(spark, sf):
    f = fills(spark, sf).where("symbol in ('1', '2', '3')")
    edge = F.lit("1996-01-01").cast("timestamp_ntz")
    first = ledger.books(f.where(F.col("at") < edge))
    stored = ledger.checkpoints_of(first)
    batch = f.where((F.col("at") >= edge) & F.col("symbol").isin("1", "2"))
    steps = watch.advanced_books(stored, batch).collect()
    assert {r.symbol for r in steps} == {"1", "2"}
    whole = {(r.symbol, r.checkpoint) for r in ledger.checkpoints_of(ledger.books(f)).collect()}
    assert {(r.symbol, r.checkpoint) for r in steps if r.row == "checkpoint"} == {x for x in whole if x[0] != "3"}
    with pytest.raises(Exception, match="fill_order_unproven"):
        watch.advanced_books(stored, f.where((F.col("at") < edge) & (F.col("symbol") == "1"))).collect()


@pytest.mark.parametrize("kind", ["half", "overlap", "apart"])
def test_greedy_selections_of_spans_of_any_width(spark, kind):
    rng = np.random.default_rng(8)
    rows = [(int(k), i, float(rng.integers(0, 50)) / 10, int(s), int(s + w)) for i, (k, s, w) in enumerate(zip(rng.integers(0, 3, 250), rng.integers(0, 900, 250), rng.integers(1, 60, 250), strict=True))]
    df = spark.createDataFrame(rows, "k long, id long, score double, start long, end long").repartition(4)
    rule = {"half": lambda a, b, c, d: abs(a - c) < max(b - a, d - c) / 2, "overlap": lambda a, b, c, d: min(b, d) - max(a, c) > 0.5 * min(b - a, d - c), "apart": lambda a, b, c, d: a < d and b > c}[kind]
    run = {"half": relational.nms_half_width, "overlap": relational.nms_overlap, "apart": lambda x, keys: relational.runner_ups(x, keys, 10_000)}[kind]
    want: list = []
    for k, i, _, a, b in sorted(rows, key=lambda r: (-r[2], r[1])):
        if not any(rule(a, b, c, d) for j, _, c, d in want if j == k):
            want.append((k, i, a, b))
    assert {r.id for r in run(df, ["k"]).collect()} == {i for _, i, _, _ in want}


def test_ancestry_of_a_long_chain_and_a_circle(spark):
    links = [(i, i - 1) for i in range(1, 40)] + [(0, None), (100, None)]
    df = spark.createDataFrame(links, "node long, parent long")
    got = {(r.node, r.ancestor, r.level) for r in relational.ancestry(df, "node", "parent").collect()}
    assert got == {(i, j, i - j) for i in range(40) for j in range(i)}
    with pytest.raises(ValueError, match="circle"):
        relational.ancestry(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"), "node", "parent")


def ticks_of(rng, n):
    at = sorted(rng.integers(0, 20 * 86_400_000_000, n).tolist())
    return [("ab"[int(rng.integers(2))], i, T0 + dt.timedelta(microseconds=x), float(rng.integers(1, 400)) / 4) for i, x in enumerate(at)]


def test_triggers_of_long_windows_equal_a_plain_search(spark):
    rng = np.random.default_rng(4)
    ticks = ticks_of(rng, 900)
    found = spark.createDataFrame(ticks, "symbol string, tick_id long, at timestamp_ntz, price double")
    b = resample(found, "1h")
    plain_bars = sorted((r.symbol, r.end, r.close) for r in b.collect())
    claims = []
    for i in range(160):
        kind, up = ("trade_touch", "bar_close")[i % 2], ("gte", "lte")[i // 2 % 2]
        price = float(rng.integers(1, 40)) if up == "lte" else float(rng.integers(60, 105))
        start = T0 + dt.timedelta(minutes=int(rng.integers(0, 15 * 1440)))
        claims.append((i, "ab"[i // 4 % 2], start, 50.0, kind, up, str(price), int(rng.integers(1, 300))))
    df = spark.createDataFrame(claims, "claim_id long, symbol string, start timestamp_ntz, base double, kind string, comparator string, price string, window_hours int")
    trigger = F.struct("kind", "comparator", "price", "window_hours", F.lit(3600).alias("interval_seconds"))
    asked = df.select("claim_id", "symbol", "start", "base", F.lit(T0 + 18 * DAY).cast("timestamp_ntz").alias("evaluated_at"), F.struct(F.lit("T3").alias("template"), trigger.alias("trigger")).alias("criteria"))
    got = {r.claim_id: (r.trigger_at, r.trigger_price) for r in rules.triggers(asked, found, b).collect()}
    want = {}
    for i, symbol, start, base, kind, up, price, hours in claims:
        reached = (lambda v: v >= float(price)) if up == "gte" else (lambda v: v <= float(price))
        end = min(start + hours * HOUR, T0 + 18 * DAY)
        if kind == "trade_touch" and reached(base):
            want[i] = (start, base)
            continue
        points = [(at, p) for s, _, at, p in ticks if s == symbol] if kind == "trade_touch" else [(at, p) for s, at, p in plain_bars if s == symbol]
        if hit := [x for x in points if start < x[0] <= end and reached(x[1])]:
            want[i] = hit[0]
    assert got == want and len(want) > 60


@pytest.mark.parametrize("step", ["1h", "4h", "1w"])
def test_paths_of_many_days_equal_a_plain_reduction(spark, step):
    rng = np.random.default_rng(6)
    ticks = ticks_of(rng, 700)
    found = spark.createDataFrame(ticks, "symbol string, tick_id long, at timestamp_ntz, price double")
    b = resample(found, step)
    rows = []
    for i in range(80):
        start = T0 + int(rng.integers(0, 400)) * HOUR
        rows.append((i, "ab"[i % 2], start, start + int(rng.integers(1, 260)) * HOUR, 40.0, "LS"[i // 2 % 2], 30.0))
    claims = spark.createDataFrame(rows, "claim_id long, symbol string, start timestamp_ntz, through timestamp_ntz, base double, direction string, distance double")
    plain_bars = sorted((r.symbol, r.start, r.end, r.high, r.low) for r in b.collect())
    for trades in (None, found):
        got = {r.claim_id: (r.highest, r.lowest, r.threshold_at, r.n_bars, r.crossed) for r in rules.paths(claims, b, trades).collect()}
        for i, symbol, start, through, base, direction, distance in rows:
            near = [x for x in plain_bars if x[0] == symbol and x[2] > start and x[1] < through]
            inside = [x for x in near if x[1] >= start and x[2] <= through]
            seen = [p for s, _, at, p in ticks if s == symbol and start < at <= through] if trades is not None else []
            hit = [s for _, s, _, h, low in inside if (base - low if direction == "S" else h - base) >= distance]
            assert got[i] == (max([base, *seen, *(x[3] for x in inside)]), min([base, *seen, *(x[4] for x in inside)]), min(hit, default=None), len(inside), len(near) > len(inside))


def chart(rng, n):
    close = 100 + np.cumsum(rng.normal(size=n))
    opened = np.concatenate([[100.0], close[:-1]])
    return np.stack([opened, np.maximum(opened, close) + 0.3, np.minimum(opened, close) - 0.3, close], 1)


def test_warped_scores_equal_the_plain_recursion():
    rng = np.random.default_rng(2)
    a, many = shapes.normalize(chart(rng, 50)), np.stack([shapes.normalize(chart(rng, 60)) for _ in range(5)])
    for b, score in zip(many, shapes.warped_all(a, many), strict=True):
        best = np.full((65, 65), np.inf)
        best[0, 0] = 0
        for i in range(1, 65):
            for j in range(max(1, i - 6), min(64, i + 6) + 1):
                cost = (np.abs(a[i - 1] - b[j - 1]) * shapes.WEIGHTS).sum()
                best[i, j] = cost + min(best[i - 1, j - 1], best[i - 1, j] + 0.025, best[i, j - 1] + 0.025)
        net = abs((a[-1, 3] - a[0, 0]) - (b[-1, 3] - b[0, 0]))
        assert abs(score - np.exp(-6 * (best[-1, -1] / 64 + 0.15 * net))) < 1e-12
        assert shapes.warped(a, b) == score


def test_a_chart_is_located_in_its_series(spark):
    rng = np.random.default_rng(9)
    series = chart(rng, 160)
    query = series[60:100]
    found = shapes.located(query, series, 40)
    assert (found["start"], found["length"], round(found["score"], 9)) == (60, 40, 1.0) and found["second"] < 0.9 and found["z"] > 2
    assert shapes.located(query, series, 40, (99, 3))["start"] == 60
    assert abs(shapes.located(query, series, 40, (39, 4))["start"] + 39 - 39) <= 8
    assert shapes.located(query, series, 40, (5000, 4)) is None and shapes.located(query, series[:10], 40) is None
    rows = spark.createDataFrame([(1, series.tolist(), 99, 3), (2, series[:10].tolist(), None, None)], "id long, ohlc array<array<double>>, last int, slack int")
    got = {r.id: (r.start, r.length) for r in shapes.locate(query, rows, 40).collect()}
    assert got == {1: (60, 40), 2: (None, None)}


def test_reranking_refuses_changed_sources(spark):
    rng = np.random.default_rng(10)
    series = chart(rng, 120)
    rows = [("x", T0 + i * HOUR, T0 + (i + 1) * HOUR, *map(float, c)) for i, c in enumerate(series)]
    b = spark.createDataFrame(rows, "symbol string, start timestamp_ntz, end timestamp_ntz, open double, high double, low double, close double")
    spans = [(1, "x", T0 + 30 * HOUR, T0 + 80 * HOUR), (2, "x", T0, T0 + 50 * HOUR), (3, "y", T0, T0 + 50 * HOUR)]
    known = spark.createDataFrame(spans, "id long, symbol string, start timestamp_ntz, end timestamp_ntz")
    met = b.select("symbol", F.col("start").alias("_at"), "open", "high", "low", "close").join(known, "symbol").where((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end")))
    hashes = {r.id: r.h for r in met.groupBy("id").agg(shapes.source_hash("_at").alias("h")).collect()}
    chosen = spark.createDataFrame([(*s, hashes.get(1) if s[0] == 1 else "other") for s in spans], "id long, symbol string, start timestamp_ntz, end timestamp_ntz, source_hash string")
    got = {r.id: (r.status, r.score is None, r["at"]) for r in shapes.exact_rerank(series[40:70], chosen, b).collect()}
    place = got[1][2]
    assert abs(place - 10) <= 3 and got == {1: ("exact", False, place), 2: ("source_changed", True, None), 3: ("source_missing", True, None)}


def test_public_candidates_are_proven_and_apart(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):
        d = shapes.descriptor(chart(rng, 64)).tolist()
        rows.append(("s" + str(i % 4), i, d, (64, 128, 256)[i % 3], 10 * i, 10 * i + 64, i % 5 > 0, None if i % 7 == 0 else "g"))
    f = spark.createDataFrame(rows, "symbol string, id long, embedding array<float>, bars int, start long, end long, published boolean, generation_id string")
    chosen, unproven = shapes.public_candidates(f, rows[3][2], 64, ["symbol"], F.lit(380), budget=7)
    got = chosen.collect()
    able = [r for r in rows if r[6] and r[5] <= 380 and r[3] in (64, 128)]
    assert unproven.first().unproven == sum(r[7] is None for r in able)
    assert got[0].id == 3 and len(got) <= 7 and {r.id for r in got} <= {r[1] for r in able if r[7]}
    for s in {r.symbol for r in got}:
        starts = [r.start for r in got if r.symbol == s]
        assert len(starts) <= 3 and all(abs(a - b) >= 32 for i, a in enumerate(starts) for b in starts[i + 1 :])


def test_dense_search_in_slices(spark, monkeypatch):
    monkeypatch.setattr(shapes, "QUERY_BYTES", 256)
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=6).round(3).tolist(), "mn"[i % 2], "xy"[i // 2 % 2], "s", i) for i in range(150)]
    r = spark.createDataFrame(rows, "id long, embedding array<double>, model string, market string, symbol string, end long").repartition(5)
    asked = [(i, rng.normal(size=6).tolist(), "mn"[i % 2], [None, "x"][i % 2], None, [None, 90][i // 2 % 2], [3, 5]) for i in range(12)]
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>, model string, market string, symbol string, cutoff long, excluded array<long>")
    got: dict = {}
    for x in shapes.nearest_of_many(r, q, 4).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append(x.id)
    for i, v, model, market, _, cutoff, excluded in asked:
        fit = [(1 - np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e), j) for j, e, m, k, _, end in rows if m == model and market in (None, k) and (cutoff is None or end <= cutoff) and j not in excluded]
        assert got[i] == [j for _, j in sorted(fit)[:4]]


@pytest.mark.parametrize(("label", "want"), [
    ("03-04 22:15", (None, 3, 4, 22, 15)), ("03/04 22:15", (None, 3, 4, 22, 15)), ("2024/03/04 22:15", (2024, 3, 4, 22, 15)), ("12-31", (None, 12, 31, None, None)), ("22:15", (None, None, None, 22, 15)),
    ("4 Mar", (None, 3, 4, None, None)), ("Mar. 4", (None, 3, 4, None, None)), ("-04 22:00", (None, None, 4, 22, 0)), ("09-10 05:", (None, 9, 10, 5, 0)), ("24:10", None), ("13-01", None), ("hello", None), ("7", None), ("", None), ("1-2-3", None), ("March 4", None), ("a very long label of a chart", None),
])
def test_time_labels(spark, label, want):
    got = spark.createDataFrame([(label,)], "t string").select(interval.time_label(F.col("t")).alias("x")).first().x
    assert (None if got is None else tuple(got)) == want


def test_stamps_take_the_nearest_year(spark):
    rows = [("12-31 23:00", dt.datetime(2024, 1, 1, 2)), ("01-01 01:00", dt.datetime(2023, 12, 31, 22)), ("02-29 00:00", dt.datetime(2024, 3, 1)), ("2020/05/06 07:08", dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "t string, near timestamp_ntz")
    got = [r["at"] for r in df.select(interval.stamp(interval.time_label(F.col("t")), F.col("near"), F.lit(0)).alias("at")).collect()]
    assert got == [dt.datetime(2023, 12, 31, 23), dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 2, 29), dt.datetime(2020, 5, 6, 7, 8)]
    assert interval.utc_offsets(None, 60) == [60, 0, 480] and interval.utc_offsets(480, 480) == [480, 0]


def test_digits_are_exact_at_any_length(spark):
    cases = ["0", "-0.0", "1", "-12.5", "0.0182", "123456789012345678901234567890.123456789", ".5", "7.", "0.005", "-0.005", "99.995", "abc", "", None, "1e5"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = df.select("t", decimals.shifted(F.col("t"), 2).alias("up"), decimals.shifted(F.col("t"), -3).alias("down"), decimals.rounded(F.col("t"), 2).alias("r"), decimals.grouped(F.col("t")).alias("g"), decimals.percent(F.col("t")).alias("p")).collect()
    tidy = lambda x: "0" if not x else format(x.normalize(), "f")
    import decimal

    with decimal.localcontext(prec=200):
        for r in got:
            if r.t in ("abc", "", None, "1e5"):
                assert r.up is None and r.down is None and r.r is None and r.p is None
                continue
            v = D(r.t)
            assert (r.up, r.down) == (tidy(v.scaleb(2)), tidy(v.scaleb(-3)))
            assert r.r == tidy(v.quantize(D("0.01"), decimal.ROUND_HALF_UP))
    by = {r.t: (r.g, r.p) for r in got}
    assert by["123456789012345678901234567890.123456789"][0] == "123,456,789,012,345,678,901,234,567,890.123456789"
    assert by["0.0182"][1] == "+1.82%" and by["-12.5"][1] == "-1250%" and by["0"][1] == "0%"


def test_labels_of_prices_and_volumes(spark):
    df = spark.createDataFrame([(12345.678, 1.5e9), (2.5, 2_340.0), (0.00012, 12.0)], "p double, v double")
    got = [tuple(r) for r in df.select(text.price_label(F.col("p")), text.volume_label(F.col("v"))).collect()]
    assert got == [("12,345.68", "1.5B"), ("2.5", "2.34K"), ("0.00012", "12")]


def zipped(path, name, body):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(name, body)
    (path).write_bytes(raw.getvalue())


def test_archives_prove_their_order(spark, tmp_path):
    millis = lambda i: 1_704_067_200_000 + i * 60_000
    lines = [f"{millis(i)},1,2,0.5,1.5,10,{millis(i + 1) - 1}" for i in (0, 1, 2, 3)]
    zipped(tmp_path / "a.zip", "a.csv", "\n".join(lines))
    zipped(tmp_path / "b.zip", "b.csv", "\n".join([lines[0], lines[2], lines[1]]))
    at = lambda i: F.lit(T0 + i * dt.timedelta(minutes=1)).cast("timestamp_ntz")
    good = files.zipped_klines(spark, f"file://{tmp_path}/a.zip")
    assert files.proven_klines(good, at(1), at(3)).count() == 2
    with pytest.raises(Exception, match="too_many_bars"):
        files.proven_klines(good, at(0), at(9), 3).collect()
    with pytest.raises(Exception, match="kline_order_unproven"):
        files.proven_klines(files.zipped_klines(spark, f"file://{tmp_path}/b.zip"), at(0), at(9)).collect()
    trade = lambda i, m, p="1": f"{i},{p},1,1,1,{millis(m)},true"
    for name, body, code in (("t1", [trade(5, 0), trade(6, 0), trade(7, 3)], None), ("t2", [trade(5, 0), trade(7, 1)], "trade_id_gap"), ("t3", [trade(5, 2), trade(6, 1)], "trade_time_order_unproven"), ("t4", [trade(5, 1441)], "trade_outside_day"), ("t5", [trade(5, 0, "0")], "invalid_trade")):
        zipped(tmp_path / f"{name}.zip", "t.csv", "\n".join(body))
        found = files.proven_trades(files.zipped_trades(spark, f"file://{tmp_path}/{name}.zip"), F.lit(T0.date()))
        if code is None:
            assert found.count() == 3
        else:
            with pytest.raises(Exception, match=code):
                found.collect()


def test_ledger_files_snapshots_and_months(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Side,Price\nBUY,1.5\nSELL,2\n")
    zipped(tmp_path / "l.zip", "l.csv", "Side,Price\nBUY,1.5\n")
    rows = files.ledger_text(spark, f"file://{tmp_path}/l.csv", "csv").orderBy("line").collect()
    assert [r.fields for r in rows] == [{"Side": "BUY", "Price": "1.5"}, {"Side": "SELL", "Price": "2"}]
    assert files.ledger_text(spark, f"file://{tmp_path}/l.zip", "zip_csv").count() == 1
    with pytest.raises(ValueError, match="unsupported_ledger_format"):
        files.ledger_text(spark, "x", "xlsx")
    (tmp_path / "tickers.json").write_text('[{"symbol": "A", "quoteVolume": "12.5", "count": 3}, {"symbol": null, "quoteVolume": "1", "count": 1}]')
    assert [tuple(r) for r in files.ticker_snapshot(spark, f"file://{tmp_path}/tickers.json").collect()] == [("A", 12.5, 3)]
    catalogue = spark.createDataFrame([("p1", "A", "1h", 10), ("p3", "A", "1h", 12)], "path string, symbol string, segment string, month int")
    wanted = spark.createDataFrame([("A", "1h", m) for m in (12, 10, 11)], "symbol string, segment string, month int")
    assert [(r.place, r.path) for r in files.months_in_order(catalogue, wanted).orderBy("place").collect()] == [(0, "p1"), (1, None), (2, "p3")]


def test_account_pages_resume_by_checkpoint(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    read = lambda: files.account_pages(spark, f"file://{tmp_path}/pages", "id long, at long")
    run = lambda: watch.incremental(read(), lambda b, n: b.write.mode("append").parquet(f"file://{tmp_path}/out"), f"file://{tmp_path}/state").awaitTermination()
    (tmp_path / "pages" / "1.json").write_text('{"id": 1, "at": 5}\n{"id": 2, "at": 5}\n')
    run()
    (tmp_path / "pages" / "2.json").write_text('{"id": 3, "at": 6}\n')
    run()
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 2, 3]


RULE = {"version": "criteria-v1", "template": "T1", "selected_by": "explicit", "direction": "L", "horizon_hours": 2, "threshold_ratio": "0.05"}
ROWS = "watch_id string, at long, trade_id long, price string, criteria string, submitted_at long, base string, bar struct<start:long,end:long,open:string,high:string,low:string,close:string>"
H = 3_600_000_000


def run_stream(spark, tmp_path, batches, start):
    path, out = f"file://{tmp_path}/rows", f"file://{tmp_path}/out"
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(ROWS).parquet(path)
        with watch.state_store(spark):
            watch.incremental(start(stream), lambda b, n: b.write.mode("append").parquet(out), f"file://{tmp_path}/state", "update").awaitTermination()
    return watch.latest(spark.read.schema(watch.RESULT).parquet(out))


def test_a_watch_without_later_rows_is_settled_by_its_timer(spark, tmp_path):
    rule = json.dumps(RULE)
    first = [("quiet", H // 2, 1, "110", rule, 0, "100", None), ("busy", H // 2, 1, "101", rule, 0, "100", None)]
    later = [("busy", H, 2, "102", None, 0, "100", None), ("other", 30 * H, 1, "100", rule, 30 * H, "100", None)]
    got = {r.watch_id: (r.state, r.reason, r.error) for r in run_stream(spark, tmp_path, [first, later, [("other", 31 * H, 2, "100", None, 30 * H, "100", None)]], watch.timed_watch_stream).collect()}
    assert got["quiet"] == ("realized", "window_completed", None)
    assert got["busy"] == ("unrealized", "window_completed", None)
    assert got["other"][0] == "pending"


def test_watches_read_bars_from_the_stream(spark, tmp_path):
    rule = json.dumps(RULE)
    bar = lambda a, b, h: {"start": a, "end": b, "open": "100", "high": h, "low": "99", "close": "100"}
    rows = [("w", H, 0, None, rule, 0, "100", bar(0, H, "101")), ("w", 2 * H, 0, None, None, 0, "100", bar(H, 2 * H, "107"))]
    gap = [("g", H, 0, None, rule, 0, "100", bar(0, H, "101")), ("g", 3 * H // 2, 0, None, None, 0, "100", bar(H + 60, 3 * H // 2, "102"))]
    got = {r.watch_id: (r.through, r.mfe, r.error) for r in run_stream(spark, tmp_path, [rows[:1] + gap[:1], rows[1:] + gap[1:]], watch.watch_stream).collect()}
    assert got["w"] == (2 * H, "0.07", None)
    assert got["g"][2] == "watch_coverage_not_contiguous"


def test_only_covered_results_are_published(spark):
    results = spark.createDataFrame([("a", 10, None), ("b", 10, None), ("c", 10, "trade_id_gap")], "watch_id string, through long, error string")
    coverage = spark.createDataFrame([("a", 10), ("b", 9), ("c", 20)], "watch_id string, covered_through long")
    assert [r.watch_id for r in watch.publishable(results, coverage).collect()] == ["a"]


def test_replays_are_stored_once(spark):
    stored = spark.createDataFrame([], "call_id long, claim_no int, kind string, result string, digest string")
    preview = spark.createDataFrame([(1, 0, "in", "out"), (1, 0, "in", "out"), (1, 0, "in", "else")], "call_id long, claim_no int, input string, result string")
    once = rules.replayed(stored, preview)
    assert once.count() == 2 and rules.replayed(once, preview).count() == 2


def test_sample_filters_refuse_unknown_values():
    for bad in ({"tag_phase": "warm"}, {"adoption": "maybe"}, {"result_states": ("won",)}):
        with pytest.raises(ValueError, match="invalid_sample_filter"):
            statistics.SampleFilters(**bad)


def test_levels_of_detail(spark):
    assert B.ladder_for("2h") == ["1m", "5m", "15m", "1h", "2h", "4h", "1d", "1w"] and B.ladder_for("1h") == list(B.LADDER)
    df = spark.createDataFrame([(1000.0, 100 * 3600, "1h"), (1000.0, 1000 * 3600, "1h"), (0.0, 10, "5m"), (300.0, 100 * 86400, "1m")], "w double, s long, c string")
    got = [r[0] for r in df.select(B.level_of_detail(F.col("w"), F.col("s"), F.col("c"), "1h")).collect()]
    assert got == ["1h", "4h", "5m", "1d"]


def test_outlines_without_shape_give_no_row(spark):
    b = spark.createDataFrame([("a", T0 + i * HOUR, T0 + (i + 1) * HOUR, 2.0 + i, 1.0) for i in range(3)] + [("b", T0, T0 + HOUR, 2.0, 1.0)], "symbol string, start timestamp_ntz, end timestamp_ntz, high double, low double")
    at = F.lit(T0 + 10 * HOUR).cast("timestamp_ntz")
    drawn = lambda v: b.select("symbol").distinct().select("symbol", F.array(*[F.lit(x) for x in v]).alias("values"), at.alias("cutoff"))
    got = sorted(B.compared_outline(b, drawn([0.0, 1.0])).collect())
    assert [(r.symbol, r.value) for r in got] == [("a", 1.0), ("a", 2.5), ("a", 4.0)]
    assert B.compared_outline(b, drawn([0.0, 1.5])).count() == 0 and B.compared_outline(b, drawn([0.5])).count() == 0


def test_hits_in_the_order_of_a_list(spark):
    hits = spark.createDataFrame([("c",), ("a",), ("z",)], "id string")
    assert [r.id for r in retrieval.in_order_of(hits, ["a", "b", "c"], "id").collect()] == ["a", "c", "z"]


def test_chunks_are_whole_characters_and_overlap(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text").limit(40).unionByName(spark.createDataFrame([(-1, "é🙂ñ" * 700), (-2, "")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    chunks: dict = {}
    for r in docs.select("doc_id", F.explode(text.utf8_chunks("text")).alias("c")).select("doc_id", "c.*").collect():
        chunks.setdefault(r.doc_id, []).append((r.start, r.end, r.text))
    for d, t in texts.items():
        raw, at = t.encode(), 0
        for a, b, part in sorted(chunks.get(d, [])):
            assert raw[a:b].decode() == part and b - a <= 480 and a <= at < b
            at = b
        assert at == len(raw)


def test_baselines_by_atr_and_direction(spark):
    rows = [(1, "L", 100.0, 106.0, 2.0, 3.0), (1, "L", 100.0, 105.0, 2.0, 3.0), (2, "S", 100.0, 93.0, 2.0, 3.0)]
    samples = spark.createDataFrame(rows, "claim_id long, direction string, base double, end_price double, atr double, atr_multiple double")
    assert {r.claim_id: (r.wins, r.n) for r in statistics.baseline_rate(samples).collect()} == {1: (1, 2), 2: (1, 1)}


def test_windows_of_a_streamed_series(spark, sf):
    b = bars(spark, sf)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.symbol, r.start, r.end) for r in shapes.windows(b, 16, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    by: dict = {}
    for r in b.orderBy("symbol", "start").collect():
        by.setdefault(r.symbol, []).append(r)
    for s, rows in by.items():
        for at in range(0, len(rows) - 15, 3):
            part = rows[at : at + 16]
            if all(x.end == y.start for x, y in zip(part[:-1], part[1:], strict=True)):
                want.add((s, part[0].start, part[-1].end))
    assert got == want


def test_late_fills_rebuild_only_their_books(spark, sf):
    f = fills(spark, sf).where("symbol in ('1', '2', '3')")
    late = f.where("symbol = '2' and trade_id = 5")
    got = watch.rebuilt_books(late, f.where("not (symbol = '2' and trade_id = 5)"))
    assert got.select("symbol").distinct().count() == 1 and got.count() == f.where("symbol = '2'").count()


def test_event_time_counts(spark, tmp_path):
    rows = [("a", T0 + i * dt.timedelta(minutes=20)) for i in range(9)] + [("b", T0)]
    spark.createDataFrame(rows, "k string, at timestamp_ntz").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k string, at timestamp_ntz").parquet(f"file://{tmp_path}/in")
    counted = watch.event_counts(stream, "at", "k", "1 hour", "10 minutes")
    out = f"file://{tmp_path}/out"
    watch.incremental(counted, lambda b, n: b.write.mode("append").parquet(out), f"file://{tmp_path}/state").awaitTermination()
    assert sorted((r.k, r.n) for r in spark.read.parquet(out).collect()) == [("a", 3), ("a", 3), ("b", 1)]


def test_published_results_of_another_version_fail(spark):
    sources = spark.createDataFrame([(1, 2), (2, 5)], "document_id long, version int")
    assert retrieval.source_by_version(sources, 1, 2).count() == 1
    with pytest.raises(Exception, match="version_mismatch"):
        retrieval.source_by_version(sources, 1, 3).collect()
