"""Watches of one symbol together: a trade is one row of the stream, whatever the number of watches.

The state of a symbol is its tape (how far it is read, the last trade, and the trades that no later one passes: the
greatest price since any moment is the first of them after it) and its live watches, in blocks. A directory holds for each block the earliest
end and the nearest levels of its watches, so a batch opens the blocks whose levels it crosses or whose end it passes, no others.
Highs and lows are not kept by watch; they are asked of the tape when a watch is judged.

Results are reduced paths, which rules.settle judges by columns, in the stream or after it.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillbar.functions.decimals import dec
from quillbar.operators import rules
from quillbar.operators.ordered import Maxima, moment
from quillbar.streaming.watch import HOUR

#: Input rows: a trade has trade_id and price; a watch has watch_id, criteria (JSON), base and atr, and `at` is its submission; a row
#: with neither says that the symbol is read up to `at`, and asks for the results of all its live watches.
ROWS = "symbol string, at long, trade_id long, price string, watch_id string, criteria string, base string, atr string"
REDUCED = "watch_id string, criteria string, start long, through long, base string, highest string, lowest string, end_price string, atr string, over boolean, error string"
#: Watches of a block, the span of ends that a block of started watches holds, and results that are worked out together.
BLOCK, SPAN, TOGETHER = 2048, 6 * HOUR, 50_000
_LATER = 1 << 62


class Side:
    """Trades (at, id, price as text) that no later one reaches: sign 1 keeps highs, -1 lows."""

    def __init__(self, sign: int, kept: list):
        self.sign, self.kept = sign, [tuple(x) for x in kept]

    def since_all(self, starts: list[tuple[int, int]]) -> list[str | None]:
        """since() of many moments."""
        place = np.searchsorted(np.array([x[0] for x in self.kept], np.int64), np.array([k[0] for k in starts], np.int64), "right")
        texts = [*(x[2] for x in self.kept), None]
        return [texts[p] if k[1] == _LATER else self.since(k) for p, k in zip(place.tolist(), starts, strict=True)]

    def since(self, key: tuple[int, int]) -> str | None:
        """The extreme of all trades after (at, id)."""
        place = bisect.bisect_right(self.kept, key, key=lambda x: (x[0], x[1]))
        return self.kept[place][2] if place < len(self.kept) else None

    def extend(self, own: list[tuple[int, int, str]], start: int) -> None:
        """own: what a batch keeps by itself; what it reaches goes, and so does what no watch asks for."""
        if own:
            best = self.sign * dec(own[0][2])
            while self.kept and self.sign * dec(self.kept[-1][2]) <= best:
                self.kept.pop()
        self.kept = [x for x in [*self.kept, *own] if x[0] >= start]


class Batch:
    """Trades of one symbol in order, with their exact ranks by price."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, price: np.ndarray):
        self.at, self.id, self.price = at, ids, price
        codes, texts = pd.factorize(price)
        values = [dec(x) for x in texts]
        self.values = sorted(set(values))
        rank = {v: i for i, v in enumerate(self.values)}
        self.rank = np.array([rank[v] for v in values], np.int64)[codes] if len(price) else np.zeros(0, np.int64)
        self.most, self.least = (Maxima(sign * self.rank) for sign in (1, -1)) if len(price) else (None, None)

    def __len__(self) -> int:
        return len(self.at)

    def after(self, key: tuple[int, int]) -> int:
        """The first place whose (at, id) is beyond key."""
        lo, hi = np.searchsorted(self.at, key[0], "left"), np.searchsorted(self.at, key[0], "right")
        return int(lo + np.searchsorted(self.id[lo:hi], key[1], "right"))

    def after_all(self, starts: list[tuple[int, int]]) -> np.ndarray:
        """after() of many moments."""
        place = np.searchsorted(self.at, np.array([k[0] for k in starts], np.int64), "right")
        for i, k in enumerate(starts):
            if k[1] != _LATER:
                place[i] = self.after(k)
        return place

    def reached(self, start: int, up: Decimal | None, down: Decimal | None) -> int:
        """The first place from start at which the price is at least `up` or at most `down`."""
        place = len(self)
        if start < place and up is not None:
            place = int(self.most.first(np.array([start]), np.array([bisect.bisect_left(self.values, up)]))[0])
        if start < len(self) and down is not None:
            least = bisect.bisect_right(self.values, down) - 1
            place = min(place, int(self.least.first(np.array([start]), np.array([-least]))[0]))
        return place

    def extremes(self, start: np.ndarray, end: np.ndarray) -> tuple[list[str | None], list[str | None]]:
        """Greatest and least price of each [start, end) as text."""
        some = np.flatnonzero(start < end)
        out = [None] * len(start), [None] * len(start)
        if len(some):
            for found, side in zip(out, (self.most, self.least), strict=True):
                rank = np.abs(side.greatest(start[some], end[some]))
                texts = {r: format(self.values[r], "f") for r in np.unique(rank).tolist()}
                for i, r in zip(some.tolist(), rank.tolist(), strict=True):
                    found[i] = texts[r]
        return out

    def kept(self, sign: int) -> list[tuple[int, int, str]]:
        """Trades that no later one of the batch reaches."""
        if not len(self):
            return []
        value = sign * self.rank
        later = np.append(np.maximum.accumulate(value[::-1])[::-1][1:], np.iinfo(np.int64).min)
        return [(int(self.at[i]), int(self.id[i]), str(self.price[i])) for i in np.flatnonzero(value > later)]


@lru_cache(maxsize=4096)
def _read(text: str) -> tuple[dict, dict[bool, tuple]]:
    """Criteria of a text, and their levels while a watch waits and after; many watches share a text."""
    c = json.loads(text)
    return c, {waiting: _levels(c, waiting) for waiting in ((True, False) if c.get("trigger") else (False,))}


def _levels(c: dict, waiting: bool) -> tuple[str | None, str | None]:
    """Prices at or above, and at or below, which something happens to a watch."""
    up, down = [], []
    if waiting:
        t = c["trigger"]
        if t["kind"] == "trade_touch":
            (up if t["comparator"] == "gte" else down).append(t["price"])
    else:
        if c.get("invalidation") is not None:
            (up if c.get("direction") == "S" else down).append(c["invalidation"])
        if c["template"] == "T4":
            (down if c["boundary_kind"] == "lower_floor" else up).append(c["boundary"])
    return min(up, key=dec, default=None), max(down, key=dec, default=None)


class Live:
    """A watch under observation. (at, number) is the moment after which trades count."""

    __slots__ = ("atr", "at", "base", "criteria", "end", "down", "name", "number", "seen", "text", "up", "waiting")
    KEPT = ("name", "text", "atr", "at", "number", "base", "waiting", "seen")

    def __init__(self, name, text, atr, at, number, base, waiting, seen):
        self.name, self.text, self.atr, self.at, self.number, self.base, self.waiting, self.seen = name, text, atr, at, number, base, waiting, seen
        self.criteria, levels = _read(text)
        self.end = at + HOUR * (self.criteria["trigger"]["window_hours"] if waiting else self.criteria["horizon_hours"])
        self.up, self.down = levels[waiting]

    @classmethod
    def begin(cls, row) -> Live:
        c, levels = _read(row.criteria)
        waiting = c["template"] == "T3"
        if waiting:
            up, down = levels[True]
            base = dec(row.base)
            waiting = not (up is not None and base >= dec(up) or down is not None and base <= dec(down))
        return cls(row.watch_id, row.criteria, row.atr, int(row.at), _LATER, row.base, waiting, 0)

    def started(self, at: int, number: int, price: str) -> Live:
        return Live(self.name, self.text, self.atr, at, number, price, False, 1)

    def key(self) -> tuple[int, int]:
        return self.at, self.number

    def place(self) -> str:
        """The block to which it belongs: by its end, or for those that wait by the level they wait for."""
        if self.waiting and (level := self.up or self.down) is not None:
            return f"{'u' if self.up else 'd'}{dec(level).adjusted()}:{str(dec(level).normalize().as_tuple().digits[:2])}"
        return f"e{self.end // SPAN}"

    def row(self) -> list:
        return [getattr(self, n) for n in self.KEPT]


class SymbolProcessor(StatefulProcessor):
    """Rows of a symbol (ROWS) -> reduced paths (REDUCED): of a watch when it ends, is touched by its invalidation or boundary, or
    meets a gap, and of all live ones where a row asks."""

    def init(self, handle) -> None:
        self._tape = handle.getValueState("tape", "json string")
        self._directory = handle.getValueState("directory", "json string")
        self._blocks = handle.getMapState("blocks", "name string", "json string")

    def close(self) -> None:
        pass

    # Blocks

    def _opened(self, name: str, number: int) -> list[Live]:
        return [Live(*x) for x in json.loads(self._blocks.getValue((f"{name}/{number}",))[0])]

    def _stored(self, directory: dict, name: str, watches: list[Live]) -> None:
        """Blocks of `name` are written anew; the directory says what would make a batch open them."""
        for number in range(directory.get(name, {}).get("blocks", 0)):
            self._blocks.removeKey((f"{name}/{number}",))
        directory.pop(name, None)
        if not watches:
            return
        for number, lo in enumerate(range(0, len(watches), BLOCK)):
            self._blocks.updateValue((f"{name}/{number}",), (json.dumps([w.row() for w in watches[lo : lo + BLOCK]]),))
        up, down = [w.up for w in watches if w.up is not None], [w.down for w in watches if w.down is not None]
        directory[name] = {"blocks": -(-len(watches) // BLOCK), "end": min(w.end for w in watches), "start": min(w.at for w in watches), "up": min(up, key=dec, default=None), "down": max(down, key=dec, default=None)}

    # One batch

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["at", "trade_id"], kind="stable")
        tape = json.loads(self._tape.get()[0]) if self._tape.exists() else {"through": None, "from": None, "last": None, "highs": [], "lows": []}
        directory = json.loads(self._directory.get()[0]) if self._directory.exists() else {}
        before = tape["through"]
        is_trade = data["trade_id"].notna() & data["price"].notna()
        found = data[is_trade & ((data["at"] > before) if before is not None else True)]
        trades = Batch(found["at"].to_numpy(np.int64), found["trade_id"].to_numpy(np.int64), found["price"].to_numpy(object))
        through = max(int(data["at"].max()), before if before is not None else int(data["at"].min()))
        asked = bool((~is_trade & data["watch_id"].isna()).any())
        step = _Step(tape, trades, through, before)

        out, moved = [], {}
        fresh = [Live.begin(r) for r in data[data["watch_id"].notna()].itertuples()]
        for watch in fresh:
            self._advance(step, watch, asked, out, moved, new=True)
        low, high = (trades.values[0], trades.values[-1]) if len(trades) else (None, None)
        for name, entry in list(directory.items()):
            crossed = high is not None and (entry["up"] is not None and high >= dec(entry["up"]) or entry["down"] is not None and low <= dec(entry["down"]))
            if not (asked or crossed or entry["end"] <= through or step.gaps):
                continue
            left: dict[str, list[Live]] = {}
            for number in range(entry["blocks"]):
                for watch in self._opened(name, number):
                    self._advance(step, watch, asked, out, left, new=False)
            self._stored(directory, name, left.pop(name, []))
            for other, watches in left.items():
                moved.setdefault(other, []).extend(watches)
            if len(out) >= TOGETHER:
                yield from self._frames(step, out)
        for name, watches in moved.items():
            held = [w for number in range(directory.get(name, {}).get("blocks", 0)) for w in self._opened(name, number)]
            self._stored(directory, name, held + watches)
        yield from self._frames(step, out)
        self._close(step, directory)

    def _frames(self, step: _Step, out: list) -> Iterator[pd.DataFrame]:
        """The rows of what was judged since the last frame."""
        if out:
            yield pd.DataFrame(step.rows(out), columns=[x.split()[0] for x in REDUCED.split(", ")])
            out.clear()

    def _advance(self, step: _Step, watch: Live, asked: bool, out: list, stays: dict, new: bool) -> None:
        if new and step.before is not None and watch.at < step.before and (watch.waiting or watch.at < step.tape["from"]):
            out.append((watch, watch.at, False, "watch_coverage_not_contiguous", True))
            return
        if (code := step.gap(watch)) is not None:
            out.append((watch, max(watch.at, step.before if step.before is not None else watch.at), False, code, False))
            return
        if watch.waiting:
            place = step.trades.reached(step.trades.after(watch.key()), *(None if x is None else dec(x) for x in (watch.up, watch.down)))
            if place < len(step.trades) and step.trades.at[place] <= watch.end:
                watch = watch.started(int(step.trades.at[place]), int(step.trades.id[place]), str(step.trades.price[place]))
        if not watch.waiting and (at := step.touched(watch)) is not None:
            out.append((watch, at, True, None, True))
            return
        if watch.end <= step.through:
            out.append((watch, watch.end, True, None, True))
            return
        if asked:
            out.append((watch, max(watch.at, step.through), False, None, True))
        stays.setdefault(watch.place(), []).append(watch)

    def _close(self, step: _Step, directory: dict) -> None:
        """Tape and directory as the next batch finds them."""
        start = min((x["start"] for x in directory.values()), default=step.through)
        if len(step.trades):
            step.highs.extend(step.trades.kept(1), start)
            step.lows.extend(step.trades.kept(-1), start)
            i = len(step.trades) - 1
            step.tape["last"] = [int(step.trades.at[i]), int(step.trades.id[i]), str(step.trades.price[i])]
        kept_from = start if step.tape["from"] is None else max(step.tape["from"], start)
        step.tape |= {"through": step.through, "from": kept_from, "highs": step.highs.kept, "lows": step.lows.kept}
        self._tape.update((json.dumps(step.tape),))
        self._directory.update((json.dumps(directory),))


class _Step:
    """What watches are asked in one batch."""

    def __init__(self, tape: dict, trades: Batch, through: int, before: int | None):
        self.tape, self.trades, self.through, self.before = tape, trades, through, before
        self.highs, self.lows = Side(1, tape["highs"]), Side(-1, tape["lows"])
        ids, at = trades.id, trades.at
        last = tape["last"]
        ahead = np.concatenate([[last[1]] if last else ids[:1] - 1, ids[:-1]]) if len(ids) else ids
        ahead_at = np.concatenate([[last[0]] if last else [-(1 << 62)], at[:-1]]) if len(ids) else at
        self.gaps = [(int(ahead_at[i]), int(at[i]), "trade_order_unproven" if ids[i] <= ahead[i] else "trade_id_gap") for i in np.flatnonzero(ids != ahead + 1)]

    def gap(self, watch: Live) -> str | None:
        """Why the trades of a watch are not proven to follow one another: a gap between two of them."""
        for a, b, code in self.gaps:
            if a > watch.at and b <= watch.end:
                return code
        return None

    def touched(self, watch: Live) -> int | None:
        up, down = (None if x is None else dec(x) for x in (watch.up, watch.down))
        if up is None and down is None:
            return None
        base = dec(watch.base)
        if up is not None and base >= up or down is not None and base <= down:
            return watch.at
        # A late watch asks the tape for what passed before it came.
        old = [side.since(watch.key()) for side in (self.highs, self.lows)]
        if up is not None and old[0] is not None and dec(old[0]) >= up or down is not None and old[1] is not None and dec(old[1]) <= down:
            return self.before
        place = self.trades.reached(self.trades.after(watch.key()), up, down)
        return int(self.trades.at[place]) if place < len(self.trades) and self.trades.at[place] <= watch.end else None

    def rows(self, asked: list[tuple[Live, int, bool, str | None, bool]]) -> list[tuple]:
        """The reduced paths of (watch, through, over, error, whole) up to `through`, all at once; without the batch where not whole."""
        if not asked:
            return []
        keys = [w.key() for w, *_ in asked]
        start = self.trades.after_all(keys)
        whole = np.array([x[4] for x in asked])
        end = np.where(whole, np.searchsorted(self.trades.at, np.array([x[1] for x in asked], np.int64), "right"), 0)
        highs, lows = self.trades.extremes(start, end)
        old_highs, old_lows = self.highs.since_all(keys), self.lows.since_all(keys)
        last, number = self.tape["last"], lru_cache(maxsize=1 << 16)(dec)
        out = []
        for i, (watch, through, over, error, _) in enumerate(asked):
            high = low = watch.base
            end_price = watch.base if watch.seen else None
            if not watch.waiting:
                if last and tuple(last[:2]) > keys[i]:
                    end_price = last[2]
                if start[i] < end[i]:
                    end_price = str(self.trades.price[end[i] - 1])
                high = max([high, *(x for x in (old_highs[i], highs[i]) if x is not None)], key=number)
                low = min([low, *(x for x in (old_lows[i], lows[i]) if x is not None)], key=number)
            out.append((watch.name, watch.text, None if watch.waiting else watch.at, through, watch.base, high, low, end_price, watch.atr, over, error))
        return out


def reduced_watches(rows: DataFrame) -> DataFrame:
    """The stream of reduced paths (REDUCED) of a stream of ROWS."""
    return rows.groupBy("symbol").transformWithStateInPandas(SymbolProcessor(), REDUCED, "Update", "None")


def judged_watches(reduced: DataFrame) -> DataFrame:
    """watch_id, through, error, state, reason, mfe, mae, signed_return of reduced paths; without Python where numbers are short."""
    c = F.from_json("criteria", rules.CRITERIA)
    claims = reduced.select(
        F.col("watch_id").alias("claim_id"), F.col("watch_id").alias("watch_id"), "through", "error", F.col("start").isNull().alias("waits"), "over",
        c.alias("criteria"), moment(F.coalesce("start", "through")).alias("start"), moment(F.col("through")).alias("evaluated_at"),
        "base", "highest", "lowest", "atr", "end_price", F.lit(True).alias("covered"), F.col("end_price").isNotNull().alias("endpoint_proven"),
    )
    found = rules.settle(claims)
    waits = lambda n, value: F.when(F.col("waits"), value).otherwise(F.col(n)).alias(n)
    nothing = F.lit(None).cast("string")
    state = F.when(F.col("over"), "not_triggered").otherwise("pending")
    return found.select("watch_id", "through", "error", waits("state", state), waits("reason", F.lit("waiting_for_trigger")), *[waits(n, nothing) for n in ("mfe", "mae", "signed_return")])


def latest_reduced(reduced: DataFrame) -> DataFrame:
    """The last reduced path of each watch."""
    rest = [c for c in reduced.columns if c != "watch_id"]
    return reduced.groupBy("watch_id").agg(F.max_by(F.struct(*rest), F.struct("through", "over", F.col("error").isNotNull())).alias("r")).select("watch_id", "r.*")


def rows_of(watches: DataFrame, trades: DataFrame) -> DataFrame:
    """ROWS of watches (watch_id, symbol, submitted_at, base, criteria, atr) and trades (symbol, trade_id, at in microseconds,
    price): as many as both together."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    one = trades.select("symbol", "at", "trade_id", F.col("price").cast("string").alias("price"), *none("string", "watch_id", "criteria", "base", "atr"))
    other = watches.select("symbol", F.col("submitted_at").alias("at"), *none("long", "trade_id"), *none("string", "price"), "watch_id", "criteria", "base", *([F.col("atr")] if "atr" in watches.columns else none("string", "atr")))
    return one.unionByName(other)
