"""Watches of a symbol together against one watch at a time, and the gap buffer."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillbar.streaming import crossings, pages, watch

H = 3_600_000_000
PLAIN = {"version": "criteria-v1", "selected_by": "explicit", "direction": "L", "horizon_hours": 5, "threshold_ratio": "0.02", "atr_multiple": None, "invalidation": None, "boundary": None, "boundary_kind": None, "trigger": None}


class Value:
    def __init__(self):
        self.now = None

    exists = lambda self: self.now is not None
    get = lambda self: self.now

    def update(self, x):
        self.now = x


class Map(dict):
    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Handle:
    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()


def rows_frame(rows):
    return pd.DataFrame(rows, columns=[x.split()[0] for x in crossings.ROWS.split(", ")]).astype({"at": "int64", "trade_id": "float64"})


def fold(batches):
    """The last result of each watch after the processor has read the batches."""
    p = crossings.SymbolProcessor()
    p.init(Handle())
    last = {}
    for rows in batches:
        for out in p.handleInputRows(("s",), iter([rows_frame(rows)]), None):
            for r in out.itertuples():
                assert r.watch_id not in last or not (last[r.watch_id].over or last[r.watch_id].error)
                last[r.watch_id] = r
    return last, p


def random_case(seed):
    rnd = random.Random(seed)
    trades, at = [], 0
    for i in range(400):
        at += rnd.choice([0, 1, H // 60, H // 6])
        trades.append(("s", at, i + 1, str(rnd.choice([100, 101.5, 99, 98.25, 103, 97])), None, None, None, None))
    watches = []
    for k in range(60):
        c = dict(PLAIN, template=rnd.choice(["T1", "T2", "T3", "T4", "T5"]), direction=rnd.choice("LS"), horizon_hours=rnd.choice([1, 3, 9, 500]))
        if c["template"] == "T2":
            c["invalidation"] = rnd.choice(["97.5", "102.5", "60", "150"])
        if c["template"] == "T4":
            c |= {"boundary": rnd.choice(["97", "103", "90", "120"]), "boundary_kind": rnd.choice(["lower_floor", "upper_ceiling"])}
        if c["template"] == "T3":
            c["trigger"] = {"kind": "trade_touch", "comparator": rnd.choice(["gte", "lte"]), "price": rnd.choice(["97", "103", "100", "200"]), "window_hours": rnd.choice([1, 4]), "interval_seconds": None}
        watches.append(("s", rnd.randrange(0, trades[-1][1]), None, None, f"w{k}", json.dumps(c), "100", "2"))
    end = ("s", trades[-1][1] + rnd.choice([0, H]), None, None, None, None, None, None)
    return trades, watches, end


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("parts", [1, 4, 40])
def test_a_shared_tape_equals_one_watch_at_a_time(seed, parts, monkeypatch):
    monkeypatch.setattr(crossings, "BLOCK", 3)
    trades, watches, end = random_case(seed)
    rows = sorted([*trades, *watches, end], key=lambda r: (r[1], r[2] is None))
    # A page ends between two moments.
    edges = sorted({rows[len(rows) * i // parts][1] for i in range(1, parts)})
    batches = [[r for r in rows if lo < r[1] <= hi] for lo, hi in zip([-1, *edges], [*edges, 1 << 61], strict=True)]
    got, processor = fold([b for b in batches if b])
    for _, at, _, _, name, text, base, atr in watches:
        alone = watch.Watch.begin(json.loads(text), at, base, atr)
        for _, t, number, price, *_ in trades:
            before = alone.deadline()
            alone.trade(t, number, price)
            alone.through = max(alone.through, min(t, before)) if t != at else alone.through
            found = alone.result(alone.last_price, alone.last_price is not None)
            # Trades of one moment are one page; what touches the rule ends the watch.
            if found["reason"] == "boundary_or_invalidation_touched":
                break
            alone.through = at if t <= at else min(t, alone.deadline()) - 1
        else:
            alone.through = max(at, min(end[1], alone.deadline()))
            found = alone.result(alone.last_price, alone.last_price is not None)
        r = got[name]
        assert r.error is None
        if r.start is None or r.start != r.start:
            assert (found["reason"], found["state"]) == ("waiting_for_trigger", "not_triggered" if r.over else "pending"), name
            continue
        assert (int(r.start), r.base) == (alone.start, alone.base), name
        if found["reason"] == "boundary_or_invalidation_touched":
            assert r.over and int(r.through) <= end[1]
        else:
            assert (float(r.highest), float(r.lowest), int(r.through)) == (float(alone.highest), float(alone.lowest), alone.through), name
            assert (r.end_price and float(r.end_price)) == (alone.last_price and float(alone.last_price)), name
    # What is over is no longer kept, and the tape holds no more than trades that no later one passes.
    live = {x[0] for k in processor._blocks for x in json.loads(processor._blocks[k][0])}
    assert live == {n for n, r in got.items() if not r.over}
    tape = json.loads(processor._tape.get()[0])
    assert len(tape["highs"]) <= 6 and len(tape["lows"]) <= 6


def test_a_gap_stops_the_watches_that_cover_it():
    c = json.dumps(dict(PLAIN, template="T1", horizon_hours=3))
    trade = lambda h, n: ("s", int(h * H), n, "100", None, None, None, None)
    ask = lambda h: ("s", int(h * H), None, None, None, None, None, None)
    begin = lambda h, name: ("s", int(h * H), None, None, name, c, "100", None)
    got, _ = fold([[begin(0, "before"), trade(1, 1), trade(1.5, 2)], [trade(2, 4), begin(1.9, "in"), begin(2.5, "after"), trade(2.6, 5)], [trade(3.1, 6), ask(4)]])
    assert got["before"].error == "trade_id_gap" and got["before"].through == int(1.5 * H)
    assert got["in"].error is None and got["after"].error is None and not got["after"].over
    late, _ = fold([[trade(1, 1), trade(2, 2)], [begin(0.5, "late"), trade(3, 3)]])
    assert late["late"].error == "watch_coverage_not_contiguous"
    back, _ = fold([[begin(0, "w"), trade(1, 5), trade(1.5, 4)]])
    assert back["w"].error == "trade_order_unproven"


def test_only_crossed_blocks_are_opened(monkeypatch):
    """Watches that wait for far levels are not read again by trades that do not reach them."""
    rows = []
    for k in range(200):
        c = dict(PLAIN, template="T3", trigger={"kind": "trade_touch", "comparator": "gte", "price": str(110 + k), "window_hours": 900, "interval_seconds": None})
        rows.append(("s", 0, None, None, f"w{k}", json.dumps(c), "100", None))
    opened, plain = [], crossings.SymbolProcessor._opened
    monkeypatch.setattr(crossings.SymbolProcessor, "_opened", lambda self, name, number: opened.append(name) or plain(self, name, number))
    p = crossings.SymbolProcessor()
    p.init(Handle())
    list(p.handleInputRows(("s",), iter([rows_frame(rows)]), None))
    opened.clear()
    for i, price in enumerate(["100", "109", "104"]):
        list(p.handleInputRows(("s",), iter([rows_frame([("s", (i + 1) * H, i + 1, price, None, None, None, None)])]), None))
    assert not opened
    list(p.handleInputRows(("s",), iter([rows_frame([("s", 9 * H, 4, "112", None, None, None, None)])]), None))
    assert 0 < len(set(opened)) < 4


def test_streamed_results_are_judged_by_columns(spark, tmp_path):
    trades, watches, end = random_case(77)
    schema = crossings.ROWS
    rows = [*trades, *watches, end]
    out, path = f"file://{tmp_path}/out", f"file://{tmp_path}/in"
    cut = trades[200][1]
    for part in ([r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(path)
        with watch.state_store(spark):
            stream = crossings.reduced_watches(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(path))
            watch.incremental(stream, lambda b, n: b.write.mode("append").parquet(out), f"file://{tmp_path}/state", "update").awaitTermination()
    found = crossings.latest_reduced(spark.read.schema(crossings.REDUCED).parquet(out))
    got = {r.watch_id: r for r in crossings.judged_watches(found).collect()}
    want, _ = fold([[*trades, *watches, end]])
    assert got.keys() == want.keys()
    states = {(r.state, r.reason) for r in got.values()}
    assert {("unrealized", "boundary_or_invalidation_touched"), ("not_triggered", "waiting_for_trigger"), ("pending", "observing")} <= states
    assert all((got[n].reason == "waiting_for_trigger") == (w.start is None or w.start != w.start) for n, w in want.items())


def test_pages_wait_for_the_archive(spark, tmp_path):
    """Shuffled, repeated and lost pages; what is lost is asked for, and nothing behind it is passed on before it came."""
    now = int(dt.datetime.now().timestamp() * 1e6)
    rows = [("s", i, now - (100 - i) * 1000, str(i)) for i in range(1, 101)]
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = spark.createDataFrame([], pages.PAGE).schema
    put = lambda some: spark.createDataFrame(some, pages.PAGE).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = pages.in_order(spark.readStream.schema(schema).parquet(path), wait_ms=1)
        watch.incremental(stream, lambda b, n: b.withColumn("n", F.lit(n)).write.mode("append").parquet(out), f"file://{tmp_path}/state", once=True).awaitTermination()

    with watch.state_store(spark):
        put(rows[60:80] + rows[:20])
        run()
        put(rows[10:20] + rows[80:])
        run()
        asked = [(r.trade_id, r.last_id) for r in spark.read.parquet(out).where("kind = 'ask'").collect()]
        assert asked and set(asked) == {(21, 60)}
        assert spark.read.parquet(out).where("kind = 'trade'").count() == 20
        put(rows[20:60])
        run()
    passed = [r.trade_id for r in spark.read.parquet(out).where("kind = 'trade'").orderBy("n", "trade_id").collect()]
    assert passed == list(range(1, 101))


def test_gaps_beyond_retention_are_errors(spark, tmp_path):
    old = int(dt.datetime.now().timestamp() * 1e6) - 72 * H
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = spark.createDataFrame([], pages.PAGE).schema
    with watch.state_store(spark):
        for part in ([("s", 1, old, "1"), ("s", 5, old + 5, "5")], [("s", 6, old + 6, "6")], [("s", 2, old + 2, "2")]):
            spark.createDataFrame(part, pages.PAGE).coalesce(1).write.mode("append").parquet(path)
            stream = pages.in_order(spark.readStream.schema(schema).parquet(path), wait_ms=1)
            watch.incremental(stream, lambda b, n: b.write.mode("append").parquet(out), f"file://{tmp_path}/state", once=True).awaitTermination()
    got = [(r.kind, r.trade_id, r.price) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [("error", 2, "rest_trade_retention_exceeded_declare_archive_recovery"), ("trade", 1, "1")]
