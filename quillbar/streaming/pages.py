"""Trades that come in pages, put in order before anything reads them.

Pages of a symbol may come late, twice or not at all. A trade is passed on once all before it are; what comes
early is held. Where a gap has lasted for `wait`, its trades are asked of the archive by a row of their own, which another stream answers with
the same kind of rows; a gap whose trades are older than the source keeps them is an error, and nothing after it is passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: Input: trades (ids follow one another, times in microseconds). Output: kind `trade`; kind `ask` with the ids that are lacking
#: (trade_id to last_id); kind `error` with a code in price.
PAGE = "symbol string, trade_id long, at long, price string"
ORDERED = "kind string, symbol string, trade_id long, last_id long, at long, price string"
WAIT_MS, RETENTION_US = 30_000, 48 * 3_600_000_000
#: Trades that one state row holds.
HELD = 4096


class GapBuffer(StatefulProcessor):
    def __init__(self, wait_ms: int = WAIT_MS, retention_us: int = RETENTION_US, first_id: int = 1):
        self.wait_ms, self.retention_us, self.first_id = wait_ms, retention_us, first_id

    def init(self, handle) -> None:
        self._handle = handle
        self._next = handle.getValueState("next", "trade_id long, at long, failed boolean")
        self._early = handle.getListState("early", "ids array<long>, at array<long>, prices array<string>")

    def close(self) -> None:
        pass

    def _place(self) -> tuple[int, int | None, bool]:
        return tuple(self._next.get()) if self._next.exists() else (self.first_id, None, False)

    def _held(self) -> pd.DataFrame:
        parts = [pd.DataFrame({"trade_id": r[0], "at": r[1], "price": r[2]}) for r in self._early.get()] if self._early.exists() else []
        return pd.concat(parts) if parts else pd.DataFrame({"trade_id": [], "at": [], "price": []})

    def _hold(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self._early.clear()
            return
        cut = [rows.iloc[lo : lo + HELD] for lo in range(0, len(rows), HELD)]
        self._early.put([(x["trade_id"].astype(int).tolist(), x["at"].astype(int).tolist(), x["price"].tolist()) for x in cut])

    def _out(self, key, kind: str, first, last, at, price) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "symbol": key[0], "trade_id": first, "last_id": last, "at": at, "price": price}, columns=[x.split()[0] for x in ORDERED.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, last_at, failed = self._place()
        if failed:
            return
        found = pd.concat([x[["trade_id", "at", "price"]] for x in rows])
        found = pd.concat([found, self._held()]) if self._early.exists() else found
        found = found[found["trade_id"].notna() & (found["trade_id"] >= number)].drop_duplicates("trade_id").sort_values("trade_id")
        run = int((found["trade_id"].to_numpy() == number + pd.RangeIndex(len(found))).cumprod().sum())
        whole, early = found.iloc[:run], found.iloc[run:]
        if run:
            times = whole["at"].astype(int)
            if not times.is_monotonic_increasing or (last_at is not None and times.iloc[0] < last_at):
                self._next.update((number, last_at, True))
                yield self._out(key, "error", [number], [None], [last_at], ["trade_time_order_unproven"])
                return
            number, last_at = number + run, int(times.iloc[-1])
            yield self._out(key, "trade", whole["trade_id"].astype(int), whole["trade_id"].astype(int), times, whole["price"])
        self._hold(early)
        self._next.update((number, last_at, False))
        timers = list(self._handle.listTimers())
        if not len(early):
            for old in timers:
                self._handle.deleteTimer(old)
        elif run or not timers:  # another gap, which waits anew
            for old in timers:
                self._handle.deleteTimer(old)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, last_at, failed = self._place()
        early = self._held()
        if failed or not len(early):
            return
        first = early.loc[early["trade_id"].idxmin()]
        now = timerValues.getCurrentProcessingTimeInMs()
        if int(first["at"]) < now * 1000 - self.retention_us:
            self._next.update((number, last_at, True))
            self._early.clear()
            yield self._out(key, "error", [number], [int(first["trade_id"]) - 1], [int(first["at"])], ["rest_trade_retention_exceeded_declare_archive_recovery"])
            return
        yield self._out(key, "ask", [number], [int(first["trade_id"]) - 1], [int(first["at"])], [None])
        self._handle.registerTimer(now + self.wait_ms)  # asked again, if the archive does not answer


def in_order(pages: DataFrame, wait_ms: int = WAIT_MS, retention_us: int = RETENTION_US, first_id: int = 1) -> DataFrame:
    """The stream ORDERED of a stream of PAGE rows, live and from the archive together."""
    return pages.groupBy("symbol").transformWithStateInPandas(GapBuffer(wait_ms, retention_us, first_id), ORDERED, "Append", "ProcessingTime")
