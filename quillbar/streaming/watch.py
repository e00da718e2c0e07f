"""Live watches: one constant-size state an assessment, fed by contiguous trades or bars. crossings.py keeps all watches of a symbol together.

The state is kept by transformWithStateInPandas; the reduction and the verdict are those of the batch.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from quillbar.functions.decimals import dec
from quillbar.operators.rules import Reduced, verdict

EPOCH = dt.datetime(1970, 1, 1)


@dataclass
class Watch:
    """A rule under observation. Times are microseconds since 1970; prices are text."""

    criteria: dict
    submitted_at: int
    through: int
    atr: str | None = None
    start: int | None = None
    base: str | None = None
    highest: str | None = None
    lowest: str | None = None
    last_id: int | None = None
    last_price: str | None = None
    error: str | None = None

    @classmethod
    def begin(cls, criteria: dict, submitted_at: int, base: str, atr: str | None = None) -> Watch:
        watch = cls(criteria, submitted_at, submitted_at, atr)
        if criteria["template"] != "T3" or watch._reached(base) and criteria["trigger"]["kind"] == "trade_touch":
            watch._start(submitted_at, base)
        return watch

    def _start(self, at: int, price: str) -> None:
        self.start, self.base, self.highest, self.lowest = at, price, price, price

    def _reached(self, price: str) -> bool:
        t = self.criteria["trigger"]
        return dec(price) >= dec(t["price"]) if t["comparator"] == "gte" else dec(price) <= dec(t["price"])

    def deadline(self) -> int:
        hours = self.criteria["horizon_hours"] if self.start is not None else self.criteria["trigger"]["window_hours"]
        return (self.start if self.start is not None else self.submitted_at) + hours * 3_600_000_000

    def trade(self, at: int, number: int, price: str) -> None:
        """One trade after `through`; ids must follow one another."""
        if at <= self.through or at > self.deadline():
            return
        if self.last_id is not None and number <= self.last_id:
            raise ValueError("trade_order_unproven")
        if self.last_id is not None and number != self.last_id + 1:
            raise ValueError("trade_id_gap")
        self.last_id, self.last_price = number, price
        if self.start is None and self.criteria["trigger"]["kind"] == "trade_touch" and self._reached(price):
            self._start(at, price)
        if self.start is not None and self.start <= at <= self.deadline():
            self._observe(price, price)

    def _observe(self, high: str, low: str) -> None:
        self.highest = max(self.highest, high, key=dec)
        self.lowest = min(self.lowest, low, key=dec)

    def trades(self, start: int, end: int, rows: list[tuple[int, int, str]]) -> None:
        """A contiguous page (start, end] of (at, id, price); a repeated start is harmless."""
        if start != self.through or end <= start or end > self.deadline():
            raise ValueError("watch_coverage_not_contiguous")
        last = start
        for at, number, price in rows:
            if at < start or at > end or at < last:
                raise ValueError("trade_time_order_unproven")
            if at != start:
                self.trade(at, number, price)
                last = at
        self.through = min(end, self.deadline())

    def bars(self, start: int, end: int, rows: list[tuple[int, int, str, str, str, str]]) -> None:
        """Contiguous bars (start, end, open, high, low, close) that cover [start, end)."""
        if start > self.through or end <= self.through or end > self.deadline():
            raise ValueError("watch_coverage_not_contiguous")
        expected = start
        for a, b, o, h, low, c in rows:
            oo, hh, ll, cc = map(dec, (o, h, low, c))
            if a != expected or b > end or b <= a or ll <= 0 or not ll <= min(oo, cc) or not max(oo, cc) <= hh:
                raise ValueError("invalid_contiguous_bars")
            expected = b
            if b <= self.through:
                continue
            if self.start is None:
                t = self.criteria["trigger"]
                if t["kind"] != "bar_close" or b - a != (t.get("interval_seconds") or 60) * 1_000_000:
                    raise ValueError("trigger_bar_interval_mismatch")
                if self._reached(c):
                    self._start(b, c)
                    self.through = b
                    return
            elif a < self.through:
                raise ValueError("partial_bar_requires_trades")
            else:
                self._observe(h, low)
        if expected != end:
            raise ValueError("bar_coverage_unproven")
        self.through, self.last_id = end, None

    def result(self, end_price: str | None, proven: bool) -> dict:
        if self.start is None:
            over = self.through >= self.deadline()
            return {"state": "not_triggered" if over else "pending", "reason": "waiting_for_trigger", "mfe": None, "mae": None, "signed_return": None}
        at = lambda us: EPOCH + dt.timedelta(microseconds=us)
        return verdict(Reduced(self.criteria, at(self.start), at(self.through), self.base, self.highest, self.lowest, True, proven, self.atr, end_price))


RESULT = "watch_id string, through long, state string, reason string, mfe string, mae string, error string"
HOUR = 3_600_000_000


class WatchProcessor(StatefulProcessor):
    """Rows: watch_id, at (microseconds), trade_id, price, and on the first row of a watch its criteria (JSON)
    with submitted_at and base; or, instead of a trade, bar (start, end in microseconds, open, high, low, close
    as text), whose `at` is its end. A gap stops the watch with an error; nothing is dropped in silence. With
    timers (an event-time column `event_time` with a watermark) a watch whose deadline the watermark passes is
    settled without waiting for later rows, and its state is removed."""

    timers = False

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState("watch", StructType([StructField("json", StringType())]))

    def _row(self, key, watch: Watch, state: dict) -> pd.DataFrame:
        return pd.DataFrame([{"watch_id": key[0], "through": watch.through, "state": state["state"], "reason": state["reason"], "mfe": state["mfe"], "mae": state["mae"], "error": watch.error}])

    def _found(self, watch: Watch) -> dict:
        return watch.result(watch.last_price, watch.last_price is not None)

    def _fed(self, watch: Watch, batch: pd.DataFrame) -> None:
        bars = batch["bar"] if "bar" in batch.columns else [None] * len(batch)
        for at, number, price, bar in zip(batch["at"].tolist(), batch["trade_id"].tolist(), batch["price"].tolist(), bars, strict=True):
            if bar is not None:
                bar = dict(bar.asDict() if hasattr(bar, "asDict") else bar)
                if bar["end"] > watch.through and bar["end"] <= watch.deadline():
                    watch.bars(bar["start"], bar["end"], [tuple(bar[k] for k in ("start", "end", "open", "high", "low", "close"))])
                    watch.last_price = bar["close"]
            elif price is not None and pd.notna(price):
                watch.trade(int(at), int(number), price)
        watch.through = max(watch.through, min(int(batch["at"].max()), watch.deadline()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "trade_id"])
        if self._state.exists():
            watch = Watch(**json.loads(self._state.get()[0]))
        else:
            head = batch[batch["criteria"].notna()].iloc[0]
            watch = Watch.begin(json.loads(head["criteria"]), int(head["submitted_at"]), head["base"])
        if watch.error is None:
            try:
                self._fed(watch, batch)
            except ValueError as e:
                watch.error = str(e)
        self._state.update((json.dumps(asdict(watch)),))
        if self.timers:
            for old in list(self._handle.listTimers()):
                self._handle.deleteTimer(old)
            self._handle.registerTimer(watch.deadline() // 1000 + 1)
        yield self._row(key, watch, self._found(watch))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watch = Watch(**json.loads(self._state.get()[0]))
        if watch.error is None:
            watch.through = watch.deadline()
        self._state.clear()
        yield self._row(key, watch, self._found(watch))

    def close(self) -> None:
        pass


class TimedWatchProcessor(WatchProcessor):
    timers = True


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark):
    """The store that keeps state by column, which these processors need; the session's own is set again after."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def watch_stream(rows: DataFrame) -> DataFrame:
    """The latest result of each watch after every batch (update mode)."""
    return rows.groupBy("watch_id").transformWithStateInPandas(WatchProcessor(), RESULT, "Update", "None")


def timed_watch_stream(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """watch_stream that settles a watch as soon as the watermark of its rows' time passes its deadline."""
    timed = rows.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", late)
    return timed.groupBy("watch_id").transformWithStateInPandas(TimedWatchProcessor(), RESULT, "Update", "EventTime")


def latest(results: DataFrame) -> DataFrame:
    """The last result of each watch; an error stops it where it stands."""
    rest = [c for c in results.columns if c not in ("watch_id", "through")]
    order = F.struct("through", F.col("error").isNotNull())
    return results.groupBy("watch_id").agg(F.max("through").alias("through"), F.max_by(F.struct(*rest), order).alias("r")).select("watch_id", "through", "r.*")


def publishable(results: DataFrame, coverage: DataFrame) -> DataFrame:
    """Results of watches whose input is covered up to where they stand: a gap is retried later, never
    published. coverage: watch_id, covered_through."""
    return results.join(coverage, "watch_id").where(F.col("error").isNull() & (F.col("covered_through") >= F.col("through"))).drop("covered_through")


def incremental(stream: DataFrame, apply, checkpoint: str, mode: str = "append", **trigger):
    """Runs apply(batch, number) for each micro-batch with its own checkpoint: projections that touch only
    the books a batch holds. Ends with the rows that are there, or as `trigger` says: states with processing-time timers ask for batches
    without end otherwise."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()


def advanced_books(stored: DataFrame, batch: DataFrame, key: str = "symbol") -> DataFrame:
    """The fold of a batch of later fills from the stored checkpoints (key, checkpoint) of its books: steps of
    ledger.books; nothing of the history is read again. Late fills raise; rebuilt_books serves those."""
    from quillbar.operators.ledger import books

    touched = stored.join(batch.select(key).distinct(), key, "left_semi")
    return books(batch, touched, key)


def rebuilt_books(batch: DataFrame, history: DataFrame, key: str = "symbol") -> DataFrame:
    """All fills of the books that a batch touches: late rows rebuild their own book, no other."""
    touched = batch.select(key).distinct()
    return history.join(touched, key, "left_semi").unionByName(batch).dropDuplicates([key, "trade_id"])


def event_counts(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Rows of each key and event-time window, with a watermark."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width), key).agg(F.count(F.lit(1)).alias("n"))
