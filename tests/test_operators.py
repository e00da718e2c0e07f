"""Operators, sources and streams on small frames."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillbar.functions import decimals, interval, text
from quillbar.operators import bars, indicators, ledger, relational, retrieval, rules, shapes, statistics
from quillbar.plans.registry import QUERIES
from quillbar.sources import files


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_functions(spark):
    for raw in ("MUUSDT", "mu/usdt", "BINANCE:MUUSDT.P", " $MU-USDT ", "ＭＵ＿ＵＳＤＴ"):
        assert one(spark, x=text.search_phrase(F.lit(raw))).x == "MUUSDT"
    row = one(spark, a=text.contains_literal(F.lit("50% of A_b"), F.lit("% OF a_")), b=text.contains_literal(F.lit("50x"), F.lit("50%")), c=text.nearest_two([64, 96, 128, 192], F.lit(100)), d=text.falling_length(F.array(*[F.lit(float(x)) for x in (5, 3, 4, 2, 6, 1)])), e=text.xml_escaped(F.lit("<a&'\">")))
    assert (row.a, row.b, row.c, row.d, row.e) == (True, False, [96, 128], 4, "&lt;a&amp;&apos;&quot;&gt;")
    cmd = lambda x: one(spark, c=text.slash_command(F.lit(x))).c
    assert cmd("/k L s=BTC h=4 theta=0.02 | why").template == "T1" and cmd("/k L L h=4 | x").template == "T0" and cmd("/k L h=x | y").direction is None
    assert one(spark, s=text.utf8_slice(F.lit("é漢a"), F.lit(0), F.lit(3))).s.asDict() == {"text": "é", "next": 2}


def test_decimal_functions(spark):
    row = one(spark, a=decimals.normalized(F.lit("1.500")), b=decimals.is_valid(F.lit("1e99")), c=decimals.trimmed(F.lit("10.100")), d=decimals.trimmed(F.lit("100")), e=decimals.label_number(F.lit("−1,234.5K")), f=decimals.printed_tolerance(F.lit("1.25")))
    assert (row.a, row.b, row.c, row.d, row.e) == ("1.5", False, "10.1", "100", -1234500.0) and abs(row.f - 0.0101) < 1e-12


def test_interval_columns_equal_values(spark):
    times = [dt.datetime(2023, 8, 10) + dt.timedelta(hours=7 * i, minutes=i) for i in range(60)] + [dt.datetime(1969, 12, 31, 1), dt.datetime(2024, 1, 31, 10)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    for name in interval.SECONDS:
        for row in df.select("t", interval.floor(F.col("t"), name).alias("f"), interval.ceil(F.col("t"), name).alias("c")).collect():
            assert row.f == interval.floor_value(row.t, name), name
            assert row.c >= row.t
    jan = one(spark, a=interval.add_bars(F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"), F.lit(1), "1M"), n=interval.bars_between(F.lit("2024-01-31").cast("timestamp_ntz"), F.lit("2024-02-29").cast("timestamp_ntz"), "1M"), k=interval.nearest(F.lit(3700.0)), z=interval.nearest(F.lit(1.0)))
    assert jan.a == dt.datetime(2024, 2, 29, 10) and jan.n == 1 and jan.k == "1h" and jan.z is None


def closes(spark, values):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i + 1), float(v), float(v) + 1, float(v) - 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, start timestamp_ntz, end timestamp_ntz, open double, high double, low double, close double")


def test_indicators(spark):
    b = closes(spark, [10, 11, 9, 12, 14, 13])
    get = lambda df, c: [r[c] for r in df.orderBy("start").collect()]
    assert get(indicators.ema(b, 3), "ema") == [None, None, 10, 11, 12.5, 12.75]
    assert get(indicators.sma(closes(spark, [1, 2, 3, 4]), 3), "sma") == [None, None, 2, 3]
    m = indicators.macd(b, 2, 3, 2)
    assert get(m, "dif")[:2] == [None, None] and get(m, "dea")[2] is None and get(m, "hist")[3] is not None
    assert get(indicators.rsi(closes(spark, [1, 2, 3, 4]), 2), "rsi") == [None, None, 100.0, 100.0]
    assert get(indicators.atr(closes(spark, [5, 5, 5]), 2), "atr") == [None, 2.0, 2.0]
    with pytest.raises(ValueError):
        indicators.macd(b, 5, 3)
    assert indicators.atr14_settlement(closes(spark, [5] * 20), F.lit("2024-01-05").cast("timestamp_ntz")).first().atr14 == "2"


def test_merge_of_nested_and_touching_intervals(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", at(0), at(2), 1), ("a", at(2), at(3), 5), ("a", at(0), at(1), 9), ("a", at(5), at(6), 2), ("a", at(5), at(6), 3), ("b", at(1), at(2), 4)]
    df = spark.createDataFrame(rows, "k string, start timestamp_ntz, end timestamp_ntz, seen int")
    got = sorted(tuple(r) for r in bars.merged(df, ["k"], "seen").select("k", "start", "end", "seen").collect())
    assert got == [("a", at(0), at(3), 9), ("a", at(5), at(6), 3), ("b", at(1), at(2), 4)]


def test_import_and_reconciliation(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id int, body string")
    staged = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (3, "c"), (4, "d"), (4, "e")], "id int, body string")
    got = {r.id: r.status for r in ledger.import_rows(stored, staged, ["id"], ["body"]).collect()}
    assert got == {1: "same", 2: "conflict", 3: "new", 4: "conflict"}
    assert ledger.append_new(stored, staged, ["id"]).count() == 4
    ours = spark.createDataFrame([("A", 10, 0), ("B", 5, 1)], "asset string, amount long, n_missing long")
    theirs = spark.createDataFrame([("A", 10), ("B", 5), ("C", 1)], "asset string, amount long")
    assert {r.asset: r.status for r in ledger.reconcile(ours, theirs, 0).collect()} == {"A": "matched_declared_range", "B": "differences", "C": "differences"}
    bad = spark.createDataFrame([("BUY", 1.0, 0.0, 0.0, 1), ("X", 1.0, 1.0, 0.0, 1)], "side string, price double, quantity double, fee double, trade_id int")
    assert {r.e for r in bad.select(ledger.fill_error().alias("e")).collect()} == {"invalid_quantity", "invalid_side"}


def test_fair_queue_paging_and_cursor(spark):
    cursor = relational.snapshot_cursor("run", {"a": "1"})
    relational.check_cursor(cursor, "run", {"a": "1"})
    with pytest.raises(ValueError):
        relational.check_cursor(cursor, "run", {"a": "2"})
    df = spark.range(5)
    assert [r.id for r in relational.page(df, [F.desc("id")], 2, (4,), ["id"]).collect()] == [3, 2, 1]
    assert relational.optional(df, id=None).count() == 5 and relational.optional(df, id=3).count() == 1


def test_quote_variants_and_levels(spark):
    hits = spark.createDataFrame([("BTC", "USDT", "1h", 1, 0.9, 0, 100), ("BTC", "USDC", "1h", 2, 0.8, 10, 110), ("BTC", "USDC", "4h", 3, 0.7, 10, 110)], "base string, quote string, interval string, id int, score double, start long, end long")
    assert {r.id for r in shapes.quote_variants(hits).collect()} == {1, 3}
    assert one(spark, a=shapes.level(F.lit(0.75)), b=shapes.level(F.lit(0.2))).asDict() == {"a": "sure", "b": "none"}


def test_published_and_repair(spark):
    f = spark.createDataFrame([(1,), (2,)], "feature_id int")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "feature_id int, generation_id int")
    gens = spark.createDataFrame([(10, "ready", 1), (11, "ready", 2), (12, "building", 3)], "generation_id int, status string, created_at int")
    assert [tuple(r) for r in shapes.published(f, links, gens).collect()] == [(1, 11)]
    docs = spark.createDataFrame([(1, 3)], "document_id int, version int")
    assert retrieval.source_by_version(docs, 1, 3).count() == 1
    with pytest.raises(Exception, match="version_mismatch"):
        retrieval.source_by_version(docs, 1, 4).collect()


def test_image_and_text_fusion(spark):
    images = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank0 int")
    texts = spark.createDataFrame([("b", 0)], "id string, rank int")
    got = {r.id: r.score for r in retrieval.image_and_text(images, texts, "id").collect()}
    assert got == {"a": 1 / 61 + 1 / 180, "b": 1 / 62 + 1 / 60}


def test_trading_calendar(spark):
    calls = spark.createDataFrame([(1, "us_equity", dt.datetime(2024, 1, 5, 3), 1), (2, "crypto", dt.datetime(2024, 1, 5, 3), 1)], "id int, market string, at timestamp_ntz, days int")
    sessions = spark.createDataFrame([(dt.date(2024, 1, d), dt.datetime(2024, 1, d, 21)) for d in (3, 4, 5, 8)], "day date, close timestamp")
    got = {r.id: r.due for r in interval.session_close(calls, sessions, F.col("market"), F.col("at"), F.col("days")).collect()}
    assert got[1].day == 5 and got[2].day == 6  # 03:00 UTC on the 5th is the 4th in New York


def test_zipped_csv_catalogue_and_plan(spark, tmp_path):
    def archive(name, rows, members=1):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for i in range(members):
                z.writestr(f"{name}{i}.csv", rows)
        (tmp_path / name).write_bytes(raw.getvalue())

    archive("BTCUSDT-1h-2024-03.zip", "open_time,o,h,l,c,v,close_time\n1709251200000,1,2,0.5,1.5,10,1709254799999\n1709254800000,1.5,2,1,1.2,5,1709258399999\n")
    k = files.zipped_klines(spark, f"file://{tmp_path}/*.zip")
    assert [(r.start, r.end) for r in k.orderBy("start").collect()] == [(dt.datetime(2024, 3, 1, h), dt.datetime(2024, 3, 1, h + 1)) for h in (0, 1)]
    assert files.kline_order_proof(k).count() == 0
    assert files.month_catalogue(k.select("path").distinct()).first().month == 2024 * 12 + 2
    archive("ETHUSDT-1h-2024-03.zip", "1,1,1,1,1,1,2\n", members=2)
    with pytest.raises(Exception, match="one_csv"):
        files.zipped_klines(spark, f"file://{tmp_path}/ETH*.zip").collect()


def test_mapped_csv_rejects(spark, tmp_path):
    (tmp_path / "f.csv").write_text("T,Px,Qty\n2024-01-01 10:00:00,1.5,2\nnot a time,1,1\n")
    good, bad = files.mapped_csv(spark, f"file://{tmp_path}/f.csv", {"traded_at": "T", "price": "Px", "quantity": "Qty"}, {"side": "BUY"}, "utc_datetime", ("traded_at", "price"))
    assert good.count() == 1 and bad.first().code == "invalid_traded_at"
    with pytest.raises(ValueError, match="missing_column"):
        files.mapped_csv(spark, f"file://{tmp_path}/f.csv", {"traded_at": "X"}, {}, "iso8601", ("traded_at",))


def test_export_verify_and_cache(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    manifest = files.export(df, f"file://{tmp_path}/out", 30).collect()
    assert sum(r.rows for r in manifest) == 100
    frozen = spark.createDataFrame(manifest)
    assert files.verified(spark, f"file://{tmp_path}/out", frozen).count() == 0
    assert files.same_rows(spark.read.schema("id long, x long").json(f"file://{tmp_path}/out"), df)
    victim = next((tmp_path / "out").glob("*.json"))
    victim.write_text('{"id":1}\n')
    for crc in (tmp_path / "out").glob(".*.crc"):
        crc.unlink()
    assert files.verified(spark, f"file://{tmp_path}/out", frozen).count() == 1
    now = F.lit("2024-01-02").cast("timestamp")
    stored = spark.createDataFrame([(1, "old", dt.datetime(2024, 1, 3)), (2, "gone", dt.datetime(2024, 1, 1))], "k int, v string, expires_at timestamp")
    kept = files.cached(stored, spark.createDataFrame([(1, "new")], "k int, v string"), ["k"], now)
    assert [(r.k, r.v) for r in kept.collect()] == [(1, "new")]


def test_stream_equals_batch(spark, sf):
    streamed = {r.watch_id: r for r in QUERIES["watch_stream"](spark, sf).collect()}
    assert streamed and all(r.error is None for r in streamed.values())
    from quillbar.sources.fixtures import load, ticks

    start = {str(r.event_id): r for r in load(spark, sf, "events").collect()}
    prices = [(r.symbol, r["at"], r.price) for r in ticks(spark, sf).collect()]
    for k, r in streamed.items():
        e = start[k]
        end = e.ts + dt.timedelta(hours=200)
        path = [(at, p) for s, at, p in prices if s == e.event_type and e.ts < at <= end]
        until = min(end, max(at for s, at, _ in prices if s == e.event_type))
        values = [str(p) for _, p in sorted(path)]
        c = {"version": "criteria-v1", "template": "T1", "selected_by": "explicit", "direction": "L", "horizon_hours": 200, "threshold_ratio": "0.05"}
        high, low = max([e.value, *map(float, values)]), min([e.value, *map(float, values)])
        want = rules.verdict(rules.Reduced(c, e.ts, until, str(e.value), str(high), str(low), True, bool(values), None, values[-1] if values else None))
        assert (r.state, r.mfe, r.mae) == (want["state"], want["mfe"], want["mae"])


def test_windowed_stream_counts(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    from quillbar.streaming.watch import event_counts

    q = event_counts(stream, "ts", "event_type", "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_statistics_status(spark):
    got = [r[0] for r in spark.createDataFrame([(19,), (20,), (33,)], "n int").select(statistics.verdict_status(F.col("n"))).collect()]
    assert got == ["insufficient", "verdict_due", "observing"]
