"""Questions about stretches of ordered points, answered while the points stream by.

Points and questions meet in one sorted partition: a question takes its place by its start, and waits, as a
few numbers, until a point answers it or its end has passed. So no join of questions with points is needed, and a batch
of points is asked by all questions together on a tree of its block maxima.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbar.operators.folds import folded


class Maxima:
    """Maxima of blocks of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), []
        size = 1 << max(0, int(self.n - 1).bit_length())
        level = np.full(size, -np.inf) if values.dtype.kind == "f" else np.full(size, np.iinfo(values.dtype).min, values.dtype)
        level[: self.n] = values
        self.levels.append(level)
        while len(level) > 1:
            level = np.maximum(level[0::2], level[1::2])
            self.levels.append(level)

    def first(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from `start` whose value is at least `least`; n where there is none."""
        top = len(self.levels) - 1
        at, height = start.astype(np.int64), np.full(len(start), -1)
        for k, level in enumerate(self.levels):
            block = at >> k
            # A block is asked where it begins at the place that was reached; else its left part was asked before.
            open_ = (height < 0) & (at < len(self.levels[0])) & (((block & 1) == 1) | (k == top))
            hit = np.zeros(len(at), bool)
            hit[open_] = level[block[open_]] >= least[open_]
            height[hit] = k
            at = np.where(open_ & ~hit, (block + 1) << k, at)
        for k in range(top - 1, -1, -1):
            inside = height > k
            left = at[inside] >> k
            right = self.levels[k][left] < least[inside]
            at[inside] = (left + right) << k
        return np.where((height >= 0) & (at < self.n), at, self.n)

    def greatest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The greatest value of each [start, end), which holds one value at least."""
        out = self.levels[0][start]
        lo, hi = start.astype(np.int64), end.astype(np.int64)
        for level in self.levels:
            some = lo < hi
            if not some.any():
                break
            odd = some & ((lo & 1) == 1)
            out[odd] = np.maximum(out[odd], level[lo[odd]])
            lo = lo + odd
            some = (lo < hi) & ((hi & 1) == 1)
            out[some] = np.maximum(out[some], level[hi[some] - 1])
            hi = hi - some
            lo, hi = lo >> 1, hi >> 1
        return out


class _FirstReach:
    """Rows of one key: points (price, point_id) and questions (question, hi, level, up), by time, points before questions."""

    def __init__(self):
        self.waiting = pd.DataFrame({"question": [], "hi": [], "level": [], "up": []})

    def push(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        asks = rows["asks"].to_numpy(bool)
        points = rows[~asks]
        asked = rows.loc[asks, ["question", "hi", "level", "up"]].assign(start=np.cumsum(~asks)[asks])
        asked = pd.concat([self.waiting.assign(start=0), asked]) if len(self.waiting) else asked
        if not len(points) or not len(asked):
            self.waiting = asked.drop(columns="start")
            return None
        price, at = points["price"].to_numpy(np.float64), points["at"].to_numpy(np.int64)
        start, hi, up = asked["start"].to_numpy(np.int64), asked["hi"].to_numpy(np.int64), asked["up"].to_numpy(bool)
        level = asked["level"].to_numpy(np.float64)
        # NaN is above all numbers, as in SQL.
        price = np.where(np.isnan(price), np.inf, price)
        place = np.full(len(asked), len(price))
        for side, sign in ((up, 1.0), (~up, -1.0)):
            if side.any():
                place[side] = Maxima(sign * price).first(start[side], sign * level[side])
        found = place < len(price)
        found[found] = at[place[found]] <= hi[found]
        self.waiting = asked[~found & (hi >= at[-1])].drop(columns="start")
        if not found.any():
            return None
        hit = points.iloc[place[found]]
        return pd.DataFrame({"question": asked["question"].to_numpy()[found], "at": hit["at"].to_numpy(), "point_id": hit["point_id"].to_numpy(np.int64), "price": hit["price"].to_numpy()})

    def done(self) -> None:
        return None


class _Extremes:
    """Rows of one key: points (price) and questions (question, hi): the greatest and least price in (at, hi]."""

    def __init__(self):
        self.waiting = pd.DataFrame({"question": [], "hi": [], "most": [], "least": []})

    def push(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        asks = rows["asks"].to_numpy(bool)
        points = rows[~asks]
        asked = rows.loc[asks, ["question", "hi"]].assign(most=-np.inf, least=np.inf, start=np.cumsum(~asks)[asks])
        asked = pd.concat([self.waiting.assign(start=0), asked]) if len(self.waiting) else asked
        price, at = points["price"].to_numpy(np.float64), points["at"].to_numpy(np.int64)
        hi, start = asked["hi"].to_numpy(np.int64), asked["start"].to_numpy(np.int64)
        end = np.searchsorted(at, hi, "right")
        some = np.flatnonzero(start < end)
        if len(some):
            for name, sign in (("most", 1.0), ("least", -1.0)):
                value = asked[name].to_numpy(np.float64).copy()
                value[some] = sign * np.maximum(sign * value[some], Maxima(sign * price).greatest(start[some], end[some]))
                asked[name] = value
        over = hi < (at[-1] if len(at) else np.iinfo(np.int64).min)
        self.waiting = asked[~over].drop(columns="start")
        return self._given(asked[over])

    def done(self) -> pd.DataFrame | None:
        return self._given(self.waiting)

    def _given(self, asked: pd.DataFrame) -> pd.DataFrame | None:
        asked = asked[np.isfinite(asked["most"].to_numpy(np.float64))]
        return asked[["question", "most", "least"]] if len(asked) else None


def _merged(keys: list[str], points: DataFrame, asked: DataFrame) -> DataFrame:
    """Points (keys, at, point_id, price) and questions (keys, at, question, hi, level, up) in one table without nulls but in keys."""
    kind = asked.schema["question"].dataType
    known = points.where("price is not null and at is not null")
    one = known.select(*keys, "at", F.lit(False).alias("asks"), "point_id", F.col("price").cast("double").alias("price"), F.lit("0").cast(kind).alias("question"), F.lit(0).cast("long").alias("hi"), F.lit(0.0).alias("level"), F.lit(False).alias("up"))
    wanted = asked.where("at < hi and question is not null")
    return one.unionByName(wanted.select(*keys, "at", F.lit(True).alias("asks"), F.lit(0).cast("long").alias("point_id"), F.lit(0.0).alias("price"), "question", "hi", "level", "up"))


def first_reached(points: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """question, at, point_id, price: the first point of the question's key after `at` and not after `hi` whose price is at
    least `level` (at most, if not up). points: keys, at, point_id, price; asked: keys, question (long), at, hi, level, up;
    times are microseconds. Points of equal time come by point_id."""
    rows = _merged(keys, points, asked.where("level is not null"))
    schema = f"question {rows.schema['question'].dataType.simpleString()}, at long, point_id long, price double"
    return folded(rows, keys, ["at", "asks", "point_id"], lambda key: _FirstReach(), schema)


def extremes(points: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """question, most, least: of the points of the question's key after `at` and not after `hi`, where there are any."""
    rows = _merged(keys, points, asked.withColumn("level", F.lit(0.0)).withColumn("up", F.lit(False)))
    schema = f"question {rows.schema['question'].dataType.simpleString()}, most double, least double"
    return folded(rows, keys, ["at", "asks", "point_id"], lambda key: _Extremes(), schema)


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def moment(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")
