"""Adapters: the driver's tables as ticks, bars, calls, claims, fills and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.functions import interval
from quillbar.session import table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, name)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, tick_id, at, price: events as trades of their type."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("tick_id"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str, step: str = "1h") -> DataFrame:
    """Bars of the ticks: symbol, start, end, open, high, low, close, volume."""
    return resample(ticks(spark, sf_dir), step)


def resample(found: DataFrame, step: str) -> DataFrame:
    """First, greatest, least and last price and the number of ticks of each grid interval."""
    order = F.struct("at", "tick_id")
    grouped = found.groupBy("symbol", interval.floor(F.col("at"), step).alias("start")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    end = interval.add_bars(F.col("start"), F.lit(1), step)
    return grouped.select("symbol", "start", end.alias("end"), "open", "high", "low", "close", "volume")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls: call_id, submitted_at, episode_id (customer), signature (priority), state."""
    o = load(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "realized").when(F.col("o_orderstatus") == "P", "unrealized").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("submitted_at"), F.col("o_custkey").alias("episode_id"), F.col("o_orderpriority").alias("signature"), state.alias("state"), F.col("o_totalprice").alias("size"))


#: Every column of lineitem, which together make its rows distinct.
LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _four(x):
    """Cut to four places, which every engine does alike."""
    return (F.floor(x * 10000).cast("decimal(14,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,4)")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills: symbol (supplier), trade_id, side, price, quantity, fee, at."""
    rows = load(spark, sf_dir, "lineitem")
    buy = (F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"))
    number = F.row_number().over(W.partitionBy("l_suppkey").orderBy(*LINE))
    return rows.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        number.cast("long").alias("trade_id"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"),
        _four(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("decimal(18,4)").alias("quantity"),
        _four(F.col("l_tax") * 10 + 0.00005).alias("fee"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("at"),
    )
