"""Indicators over bars. What a frame can say is a window function; recursive averages are folded over sorted
partitions in numpy, in time linear in the series and without holding one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.functions.decimals import dec, fmt, q, ratio
from quillbar.operators.folds import folded


def _order(key: str):
    return W.partitionBy(key).orderBy("start")


def sma(bars: DataFrame, n: int, key: str = "symbol", value: str = "close") -> DataFrame:
    """Mean of the last n values, null before the n-th."""
    w = _order(key)
    return bars.withColumn("sma", F.when(F.row_number().over(w) >= n, F.avg(value).over(w.rowsBetween(1 - n, 0))))


def bollinger(bars: DataFrame, n: int, k: float, key: str = "symbol", value: str = "close") -> DataFrame:
    w = _order(key)
    ready, frame = F.row_number().over(w) >= n, w.rowsBetween(1 - n, 0)
    middle, spread = F.avg(value).over(frame), F.stddev_pop(value).over(frame) * k
    return bars.select("*", F.when(ready, middle).alias("middle"), F.when(ready, middle + spread).alias("upper"), F.when(ready, middle - spread).alias("lower"))


def true_range(bars: DataFrame, key: str = "symbol") -> DataFrame:
    before = F.lag("close").over(_order(key))
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.withColumn("true_range", wide)


class RecursiveMean:
    """Null until the n-th value that is not null, there the mean of the first n, then moved by alpha
    towards each value. Series may be pushed in parts."""

    def __init__(self, n: int, alpha: float):
        self.n, self.alpha, self.first, self.last = n, alpha, [], None

    def push(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), np.nan)
        known = np.flatnonzero(~np.isnan(values))
        x = values[known]
        if self.last is None:
            need = self.n - len(self.first)
            self.first.extend(x[:need])
            if len(self.first) < self.n:
                return out
            self.last = float(np.mean(self.first))
            out[known[need - 1]] = self.last
            known, x = known[need:], x[need:]
        if len(x):
            moved = pd.Series(np.concatenate([[self.last], x])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()
            out[known], self.last = moved[1:], float(moved[-1])
        return out


def recursive_mean(values: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """RecursiveMean of one whole series."""
    return RecursiveMean(n, alpha).push(values)


def _folded(bars: DataFrame, key: str, fields: list[str], begin, names: list[str]) -> DataFrame:
    """begin() -> a function from the next values of the fields to those of the named results; the bars of
    a key are read in order of start."""
    kind = bars.schema[key].dataType.simpleString()

    class Fold:
        def __init__(self, _):
            self.step = begin()

        def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
            found = self.step(*(pdf[f].to_numpy(np.float64) for f in fields))
            return pd.DataFrame({key: pdf[key], "start": pdf["start"]} | dict(zip(names, found, strict=True)))

        def done(self) -> None:
            return None

    schema = f"{key} {kind}, start timestamp_ntz, " + ", ".join(f"{n} double" for n in names)
    out = folded(bars.select(key, "start", *fields), [key], ["start"], Fold, schema)
    return out.select(key, "start", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def ema(bars: DataFrame, n: int, key: str = "symbol", value: str = "close") -> DataFrame:
    """Exponential mean with alpha 2 / (n + 1), seeded with the mean of the first n values."""

    def begin():
        mean = RecursiveMean(n, 2 / (n + 1))
        return lambda v: [mean.push(v)]

    return _folded(bars, key, [value], begin, ["ema"])


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, key: str = "symbol") -> DataFrame:
    """dif = fast - slow mean, dea = mean of dif, hist = 2 * (dif - dea). Needs 1 <= fast < slow <= 500."""
    if not (1 <= fast < slow <= 500 and 1 <= signal <= 500):
        raise ValueError("invalid_macd_periods")

    def begin():
        quick, calm, line = (RecursiveMean(n, 2 / (n + 1)) for n in (fast, slow, signal))

        def step(close):
            dif = quick.push(close) - calm.push(close)
            dea = line.push(dif)
            return [dif, dea, 2 * (dif - dea)]

        return step

    return _folded(bars, key, ["close"], begin, ["dif", "dea", "hist"])


def atr(bars: DataFrame, n: int = 14, key: str = "symbol") -> DataFrame:
    """Wilder's mean of true ranges, the first being high - low."""
    ranged = true_range(bars, key)

    def begin():
        mean = RecursiveMean(n, 1 / n)
        return lambda v: [mean.push(v)]

    return _folded(ranged, key, ["true_range"], begin, ["atr"])


def rsi(bars: DataFrame, n: int = 14, key: str = "symbol") -> DataFrame:
    """100 - 100 / (1 + up / down) by Wilder's means of rises and falls; 100 where down is 0; null up to
    the n-th change."""

    def begin():
        rises, falls, before = RecursiveMean(n, 1 / n), RecursiveMean(n, 1 / n), np.nan

        def step(close):
            nonlocal before
            change, before = np.diff(close, prepend=before), close[-1]
            up, down = rises.push(np.maximum(change, 0)), falls.push(np.maximum(-change, 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                return [np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))]

        return step

    return _folded(bars, key, ["close"], begin, ["rsi"])


def _settlement_atr(pdf: pd.DataFrame) -> str | None:
    """ATR14 of at most 121 closed bars in 34-digit decimals; null below 15 bars."""
    rows = pdf.sort_values("start").tail(121)
    if len(rows) < 15:
        return None
    high, low, close = ([dec(str(x)) for x in rows[c]] for c in ("high", "low", "close"))
    ranges = [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, len(rows))]
    total = ranges[0]
    for x in ranges[1:14]:
        total = q(total + x)
    value = ratio(total, dec("14"))
    for x in ranges[14:]:
        value = ratio(q(value * 13 + x), dec("14"))
    return fmt(value)


def atr14_settlement(bars: DataFrame, asof: Column, key: str = "symbol") -> DataFrame:
    """The exact ATR that settlement uses, from the last 121 bars closed by `asof` of each key."""
    late = W.partitionBy(key).orderBy(F.desc("start"))
    last = bars.where(F.col("end") <= asof).withColumn("_n", F.row_number().over(late)).where("_n <= 121")
    text = last.select(key, "start", *[F.col(c).cast("string").alias(c) for c in ("high", "low", "close")])
    kind = bars.schema[key].dataType.simpleString()
    return text.groupBy(key).applyInPandas(lambda pdf: pd.DataFrame({key: [pdf[key].iloc[0]], "atr14": [_settlement_atr(pdf)]}), f"{key} {kind}, atr14 string")


def extremes(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Greatest high and least low of each key and when they were first reached."""
    return bars.groupBy(key).agg(F.max("high").alias("high"), F.min_by("start", F.struct(-F.col("high"), "start")).alias("high_at"), F.min("low").alias("low"), F.min_by("start", F.struct("low", "start")).alias("low_at"))
