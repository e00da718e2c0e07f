"""What the findings of the third review were about."""

import itertools
import json
import re
from decimal import ROUND_HALF_UP, Context, Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillbar import session
from quillbar.functions import decimals, interval
from quillbar.operators import ledger, ordered, relational, retrieval, runs, shapes, text_index, vector_index
from quillbar.plans import domain_plans
from quillbar.plans.registry import ORACLES, QUERIES
from quillbar.sources.fixtures import fills, load
from quillbar.streaming import crossings
from tests import test_crossings


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, f"file://{folder}")
    rel = con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})")
    got = sorted(map(tuple, df.collect()), key=repr)
    return got == sorted(rel.fetchall(), key=repr) and len(got) > 0


def test_claims_are_not_broadcast_by_day(spark, sf):
    plan = QUERIES["traded_extremes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_all_pages_are_one_scan(spark, tmp_path):
    path, filters = f"file://{tmp_path}/r", {"a": 1}
    made = spark.range(95).select("id", (F.col("id") * 7919 % 101).alias("score"), F.lit(1).cast("long").alias("closed_at"))
    runs.freeze(made, path, "one", [F.desc("score"), "id"], filters, 1)
    first, cursor = runs.page(spark, path, filters, 20)
    runs.freeze(made.limit(7), path, "two", ["id"], filters, 1)
    rest = runs.pages(spark, path, filters, 20, cursor)
    assert rest._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    by_page = {}
    for r in rest.orderBy("place").collect():
        by_page.setdefault(r.page, []).append(r.id)
    one, n = [], cursor
    while n:
        rows, n = runs.page(spark, path, filters, 20, n)
        one.append([r.id for r in rows.collect()])
    assert [by_page[k] for k in sorted(by_page)] == one and sum(map(len, one)) == 75 and first.count() == 20


def test_frozen_pages_has_as_many_scans_for_many_books(spark, sf, tmp_path):
    line = load(spark, sf, "lineitem").withColumn("l_suppkey", F.col("l_suppkey") * 30 + F.col("l_orderkey") % 30)
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["frozen_pages"](spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    assert same_as_sql(spark, tmp_path, "frozen_pages", ["lineitem"])


def test_a_claim_whose_price_is_its_level_waits_for_the_next_tick(spark, sf, tmp_path):
    load(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/events.parquet")
    assert same_as_sql(spark, tmp_path, "trigger_search", ["events"])


def test_labels_and_decimals_are_worked_out_once(spark):
    """A pattern is in the plan as often as it is matched, not once for each part that needs it."""
    df = spark.createDataFrame([("09-10 05:30",)], "t string")
    plan = df.select(interval.time_label(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") < 15
    plan = df.select(decimals.percent(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") < 8 and "_half_up" not in plan


def test_decimals_of_any_length_round_on_digits(spark):
    texts = ["9.95", "-9.949", "99999999999999999999999999999999999999999.96", "-0.04", ".5", "5.", "0009.99", "+1.05", " 2.5 ", "-.05", ".", "", "1e5", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.r for r in df.orderBy("i").select(decimals.rounded(F.col("t"), 1).alias("r")).collect()]
    want = [None if x is None or not re.match(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$", x) else decimals.plain(Decimal(x.strip()).quantize(Decimal("0.1"), ROUND_HALF_UP, Context(prec=100))) for x in texts]
    assert got == want
    for places in (2, -3, 0, 7):
        moved = [r.r for r in df.orderBy("i").select(decimals.shifted(F.col("t"), places).alias("r")).collect()]
        assert moved == [None if x is None else decimals.plain(Decimal(x.strip()).scaleb(places, Context(prec=100))) for x in [t if w is not None else None for t, w in zip(texts, want, strict=True)]]
    tens = df.orderBy("i").select(decimals.rounded(F.col("t"), -1).alias("r")).collect()
    assert [tens[0].r, tens[2].r, tens[8].r] == ["10", "1" + "0" * 41, "0"]


def test_books_write_only_the_rows_that_are_asked_for(spark, sf):
    """And those of many books are one frame, with the same rows."""
    f = fills(spark, sf)
    every = ledger.books(f).drop("commissions")
    for kind in ledger.KINDS:
        some = ledger.books(f, kinds=(kind,)).drop("commissions")
        assert sorted(map(tuple, some.collect()), key=repr) == sorted(map(tuple, every.where(F.col("row") == kind).collect()), key=repr)
    assert {r.row for r in ledger.books(f, kinds=("cycle",)).select("row").distinct().collect()} == {"cycle"}


def test_an_exact_search_is_the_scan_whatever_the_pool(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=9)], "m", "ab"[i % 2], "S", i) for i in range(600)]
    rows += [(600 + i, r[1], *r[2:5], 600 + i) for i, r in enumerate(rows[:60])]  # copies tie
    df = spark.createDataFrame(rows, "id long, embedding array<double>, model string, market string, symbol string, end long")
    path = f"file://{tmp_path}/i"
    vector_index.create(df, path)
    vector_index.add(df, path)
    asked = df.where("id % 40 = 0").select(F.col("id").cast("string").alias("query_id"), "embedding", "model", F.when(F.col("id") % 80 == 0, F.col("market")).alias("market"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("long").alias("cutoff"), F.array("id").alias("excluded"))
    rank = lambda found: sorted((r.query_id, r["rank"], r.id) for r in found.collect())
    want = rank(shapes.nearest_of_many(df, asked, 10))
    assert rank(vector_index.search(asked, path, 10, pool=10, exact=True)) == want
    assert rank(vector_index.search(asked, path, 10, pool=10)) != want


def test_a_slot_of_many_spans_is_several_small_tables(spark, sf, tmp_path, monkeypatch):
    """Points and spans meet in hash tables of a bounded number of rows, of which a slot with more has several."""
    monkeypatch.setattr(relational, "HELD", 20)
    load(spark, sf, "events").withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert "ShuffledHashJoin" in QUERIES["interval_join"](spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert same_as_sql(spark, tmp_path, "interval_join", ["events"])


def test_parts_and_spans_of_cycles_are_those_of_books_without_python(spark, sf):
    f = fills(spark, sf)
    books = ledger.books(f)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(ledger.allocations(f)) == rows(ledger.allocations_of(books)) and rows(ledger.allocations(f))
    columns = ["symbol", "ordinal", "direction", "opened_at", "closed_at", "status"]
    assert rows(ledger.spans(f).select(columns)) == rows(ledger.cycles_of(books).select(columns))
    for name in ("allocations_total", "cycle_spans", "cycle_totals"):
        assert "InPandas" not in (plan := QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()) and "EvalPython" not in plan
    again = f.limit(1).unionByName(f.limit(1))
    for made in (ledger.allocations, ledger.spans):
        with pytest.raises(Exception, match="fill_order_unproven"):
            made(again).collect()
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    long = spark.range(1, 4).select(F.lit("a").alias("symbol"), at.alias("at"), F.col("id").alias("trade_id"), F.lit("BUY").alias("side"), *[(F.col("id") * 0.1).cast("decimal(30,10)").alias(c) for c in ("price", "quantity", "fee")])
    assert rows(ledger.allocations(long)) == rows(ledger.allocations_of(ledger.books(long)))


def test_what_is_to_repair_is_found_by_one_exchange(spark):
    make = lambda rows, schema="document_id long, version int": spark.createDataFrame(rows, schema)
    sources = make([(1, 2), (1, 2), (2, 2), (3, 2), (3, 1), (4, None), (5, 2), (6, 2), (None, 2)])
    indexed, vectors = make([(1, 2), (2, 1), (2, 3), (3, 2), (4, None), (5, 2), (9, 2), (None, 2)]), make([(1,), (1,), (2,), (3,), (4,), (8,), (None,)], "document_id long")
    found = retrieval.to_repair(sources, indexed, vectors)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.document_id for r in found.collect()), key=repr) == [2, 3, 4, 5, 6, None]


def test_all_phrases_meet_the_texts_once(spark, sf, tmp_path):
    plan = QUERIES["literal_index"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Relation") == 2
    texts = ["The end", "the", "ab", "AB cab", "", None, "10% off", "Über", "ab", "x"]
    docs = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "id long, t string")  # one id has two texts
    text_index.add(docs, path := f"file://{tmp_path}/i", "id", "t")
    phrases = ["the", "THE E", "ab", "", "ü", "%", "none of it", "cab", "ab"]
    got = sorted((r.phrase, r.id, r.t) for r in text_index.search_all(docs, path, phrases, "id", "t").collect())
    want = sorted((p, r.id, r.t) for p in phrases for r in text_index.search(docs, path, p, "id", "t").collect())
    assert got == want and len({p for p, _, _ in got}) == 7
    assert text_index.search_all(docs, path, ["none of it"], "id", "t").count() == 0


def test_recall_is_counted_without_writing_pools(spark, tmp_path, monkeypatch):
    """The nearest rows that a search's pool holds, and what is written for a table of 3,000 vectors: rows, not a tenth of them a query."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=12)], "m", "ab"[i % 2], "S" if i % 5 else None, i) for i in range(900)]
    rows += [(900 + i, r[1], *r[2:5], 900 + i) for i, r in enumerate(rows[:90])]  # copies tie
    df = spark.createDataFrame(rows, "id long, embedding array<double>, model string, market string, symbol string, end long")
    path = f"file://{tmp_path}/i"
    vector_index.create(df, path)
    vector_index.add(df, path)
    kinds = [("cast(null as string)", "cast(null as string)", "cast(null as long)"), ("market", "cast(null as string)", "cast(null as long)"), ("cast(null as string)", "'S'", "id + 100L")]
    asked = [df.where("id % 45 = 0").selectExpr(f"concat('{n}:', id) as query_id", "embedding", "model", f"{m} as market", f"{s} as symbol", f"{c} as cutoff", "array(id) as excluded") for n, (m, s, c) in enumerate(kinds)]
    asked = asked[0].unionByName(asked[1]).unionByName(asked[2])
    exact = shapes.nearest_of_many(df, asked, 15).select("query_id", "id")
    pairs = lambda found: {(r.query_id, r.id) for r in found.select("query_id", "id").collect()}
    want = pairs(exact)
    for pool in (15, 40, 400):
        got = pairs(vector_index.reached(exact, asked, path, pool))
        assert got == want & pairs(vector_index.search(asked, path, 15, pool=pool)) and (pool < 400) == (got != want)

    count = itertools.count()
    vectors = [(i, [float(x) for x in rng.normal(size=64).astype(np.float32)], i % 8) for i in range(3000)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/t/embeddings.parquet")
    monkeypatch.setattr(session, "shared_path", lambda _, name: f"file://{tmp_path}/shared/{name}-{next(count)}")
    got = QUERIES["chart_recall"](spark, f"file://{tmp_path}/t").collect()
    assert len(got) == 6 and all(r.recall > 0.95 and r.n == 600 or r.kind == "2" for r in got)
    most = max(spark.read.parquet(str(p)).count() for p in (tmp_path / "shared").iterdir())
    assert most <= 2 * 3000 + 180 * 20  # 180 queries with pools of 300 are 54,000


def test_results_of_a_batch_are_worked_out_together(monkeypatch):
    """Extremes are asked of the tape once a side and frame, however many watches end or are asked for."""
    criteria = json.dumps(dict(test_crossings.PLAIN, template="T1", horizon_hours=2))
    trade = lambda i: ("s", i * 1000, i + 1, str(100 + i * 7919 % 31), None, None, None, None)
    rows = [trade(i) for i in range(300)] + [("s", i * 1000, None, None, f"w{i}", criteria, "100", None) for i in range(300)]
    calls, plain = [], ordered.Maxima.greatest
    monkeypatch.setattr(ordered.Maxima, "greatest", lambda self, *x: calls.append(1) or plain(self, *x))
    got, _ = test_crossings.fold([[*rows, ("s", 300_000, None, None, None, None, None, None)]])
    assert len(got) == 300 and len(calls) <= 2
    prices = [float(trade(i)[3]) for i in range(300)]
    assert all(float(got[f"w{i}"].highest) == max([100, *prices[i + 1 :]]) and float(got[f"w{i}"].lowest) == min([100, *prices[i + 1 :]]) for i in range(300))


def test_batches_of_a_stream_are_bounded(spark, sf, tmp_path, monkeypatch):
    load(spark, sf, "events").where("event_id % 4 = 0").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(domain_plans, "BATCH_ROWS", 130)
    monkeypatch.setattr(crossings, "TOGETHER", 20)
    fed, plain = [], crossings.reduced_watches
    monkeypatch.setattr(crossings, "reduced_watches", lambda rows: fed.append(1) or plain(rows))
    assert same_as_sql(spark, tmp_path, "watch_stream", ["events"]) and len(fed) == 4


def test_fills_in_one_loop_are_those_one_at_a_time(monkeypatch):
    """Cycles, commissions and checkpoints of both are equal, digit for digit, and the loop calls nothing once a fill."""
    rng, ended = np.random.default_rng(11), 0
    for case in range(20):
        n = 200
        quantity = [Decimal(int(x)) * Decimal("0.0001") for x in rng.integers(0 if case % 2 else 1, 9, n) * 12345]
        price, fee = ([Decimal(int(x)) * Decimal("0.0001") for x in rng.integers(1, 10_000_000, n)] for _ in range(2))
        columns = [list(range(n)), list(range(n)), ["BUY" if x else "SELL" for x in rng.integers(0, 2, n)], price, quantity, fee, [["", "USD"][x] for x in rng.integers(0, 2, n)]]
        alone, together = ledger.Book(*([None] if case == 5 else [])), ledger.Book(*([None] if case == 5 else []))
        for at, trade_id, side, p, k, f, asset in zip(*columns, strict=True):
            alone.fill(pd.Timestamp(at), trade_id, side, p, k, f, asset=asset)
        columns[0] = [pd.Timestamp(x) for x in columns[0]]
        with monkeypatch.context() as m:
            if case != 5:  # an unknown opening is folded one at a time
                m.setattr(ledger.Book, "fill", None)
            for lo in range(0, n, 70):
                together.run(*(c[lo : lo + 70] for c in columns))
        assert str(together.cycles) == str(alone.cycles) and str(together.paid) == str(alone.paid) and together.checkpoint() == alone.checkpoint()
        ended += len(alone.cycles)
    assert ended > 50
    with pytest.raises(ValueError, match="fill_order_unproven"):
        together.run(*(c[:1] for c in columns))
