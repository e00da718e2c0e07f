"""Queries over bars, coverage, intervals and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillbar.functions import interval
from quillbar.operators import bars as B
from quillbar.operators import indicators as I
from quillbar.plans.catalog import query
from quillbar.sources import files
from quillbar.sources.fixtures import bars, fills, load, ticks


def bar_sql(bucket: str, end: str) -> str:
    return f"""SELECT event_type AS symbol, {bucket} AS "start", {end} AS "end", arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS "close", count(*) AS volume FROM events GROUP BY 1, 2, 3"""


HOUR = bar_sql("time_bucket(INTERVAL 1 HOUR, ts)", "time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR")
DAY = bar_sql("time_bucket(INTERVAL 1 DAY, ts)", "time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY")
B1 = f"WITH b AS ({HOUR})"

for _step, _bucket, _length in (
    ("1h", "time_bucket(INTERVAL 1 HOUR, ts)", "INTERVAL 1 HOUR"),
    ("1d", "time_bucket(INTERVAL 1 DAY, ts)", "INTERVAL 1 DAY"),
    ("3d", "time_bucket(INTERVAL 3 DAYS, ts, TIMESTAMP '1970-01-02')", "INTERVAL 3 DAYS"),
    ("1w", "time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-05')", "INTERVAL 7 DAYS"),
    ("1M", "date_trunc('month', ts)::TIMESTAMP", "INTERVAL 1 MONTH"),
):
    _name = {"1h": "bars_1h", "1d": "bars_1d", "3d": "bars_3d_grid", "1w": "bars_weekly", "1M": "bars_monthly"}[_step]
    query(_name, bar_sql(_bucket, f"{_bucket} + {_length}"))(lambda spark, d, step=_step: bars(spark, d, step))


@query("interval_floors", "\nUNION ALL ".join(f"SELECT event_id, '{n}' AS step, time_bucket(INTERVAL {s} SECONDS, ts, TIMESTAMP '{o}') AS floor FROM events" for n, s, o in [("1m", 60, "1970-01-01"), ("3m", 180, "1970-01-01"), ("15m", 900, "1970-01-01"), ("4h", 14400, "1970-01-01"), ("12h", 43200, "1970-01-01"), ("3d", 259200, "1970-01-02"), ("1w", 604800, "1970-01-05")]))
def interval_floors(spark, d):
    steps = ["1m", "3m", "15m", "4h", "12h", "3d", "1w"]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), interval.floor(F.col("ts"), s).alias("floor")) for s in steps]))
    return load(spark, d, "events").select("event_id", each.alias("x")).select("event_id", "x.step", "x.floor")


@query("interval_months", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderdate + INTERVAL 1 MONTH AS next_month, CAST(datediff('month', TIMESTAMP '1995-01-01', date_trunc('month', o_orderdate)) AS BIGINT) AS months FROM orders")
def interval_months(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return o.select("o_orderkey", interval.floor(F.col("at"), "1M").alias("month"), interval.add_bars(F.col("at"), F.lit(1), "1M").alias("next_month"), interval.bars_between(F.lit("1995-01-01").cast("timestamp_ntz"), F.col("at"), "1M").alias("months"))


@query("interval_bars_between", "SELECT event_id, CAST(floor(epoch_us(ts) / 1e6 / 14400) - floor(1704067200 / 14400) AS BIGINT) AS n, CASE WHEN ts = time_bucket(INTERVAL 4 HOURS, ts) THEN ts ELSE time_bucket(INTERVAL 4 HOURS, ts) + INTERVAL 4 HOURS END AS up FROM events")
def interval_bars_between(spark, d):
    return load(spark, d, "events").select("event_id", interval.bars_between(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"), "4h").alias("n"), interval.ceil(F.col("ts"), "4h").alias("up"))


@query("gap_pairs", f"""{B1}, p AS (SELECT symbol, lag("end") OVER (PARTITION BY symbol ORDER BY "start") AS gap_start, "start" AS gap_end FROM b)
SELECT * FROM p WHERE gap_start < gap_end""")
def gap_pairs(spark, d):
    return B.gaps(bars(spark, d))


ISLANDS = """, r AS (SELECT *, max("end") OVER (PARTITION BY symbol ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT symbol, min("start") AS "start", max("end") AS "end" FROM i GROUP BY symbol, island)"""


@query("gap_islands", f'{B1}{ISLANDS} SELECT * FROM m')
def gap_islands(spark, d):
    return B.merged(bars(spark, d).select("symbol", "start", "end"), ["symbol"])


@query("gap_merge_seen", """WITH g AS (SELECT user_id % 7 AS symbol, ts AS "start", ts + INTERVAL (event_id % 5) HOUR AS "end", event_id AS seen FROM events),
r AS (SELECT *, max("end") OVER (PARTITION BY symbol ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g WHERE "start" < "end"),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT symbol, min("start") AS "start", max("end") AS "end", max(seen) AS seen FROM i GROUP BY symbol, island""")
def gap_merge_seen(spark, d):
    spans = load(spark, d, "events").select((F.col("user_id") % 7).alias("symbol"), F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 5).cast("int"))).alias("end"), F.col("event_id").alias("seen"))
    return B.merged(spans.where("start < end"), ["symbol"], "seen")


@query("missing_ranges", f"""{B1}, c AS (SELECT symbol, greatest("start", TIMESTAMP '2024-01-05') AS "start", least("end", TIMESTAMP '2024-01-20') AS "end" FROM b WHERE "start" < TIMESTAMP '2024-01-20' AND "end" > TIMESTAMP '2024-01-05'),
e AS (SELECT * FROM c UNION ALL SELECT DISTINCT symbol, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-05' FROM b UNION ALL SELECT DISTINCT symbol, TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-20' FROM b),
p AS (SELECT symbol, max("end") OVER (PARTITION BY symbol ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "start", "start" AS "end" FROM e)
SELECT * FROM p WHERE "start" < "end" """)
def missing_ranges(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return B.missing(bars(spark, d), ["symbol"], at("2024-01-05"), at("2024-01-20"))


@query("coverage_proof", f"""{B1}, p AS (SELECT *, lag("end") OVER (PARTITION BY symbol ORDER BY "start") AS before FROM b)
SELECT symbol, count(*) AS n_bars, min("start") = TIMESTAMP '2024-01-02' AND max("end") = TIMESTAMP '2024-01-29' AND bool_and(coalesce(before = "start", true)) AS complete
FROM p WHERE "start" >= TIMESTAMP '2024-01-02' AND "end" <= TIMESTAMP '2024-01-29' GROUP BY symbol""")
def coverage_proof(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    found = bars(spark, d)
    return B.coverage_proof(found, at("2024-01-02"), at("2024-01-29"))


@query("contiguity", f"""{B1}, p AS (SELECT *, lag("end") OVER (PARTITION BY symbol ORDER BY "start") AS before FROM b)
SELECT symbol, "start", CASE WHEN before IS NULL THEN 'first' WHEN before = "start" THEN 'contiguous' WHEN before > "start" THEN 'overlap' ELSE 'gap' END AS relation FROM p""")
def contiguity(spark, d):
    return B.contiguity(bars(spark, d)).select("symbol", "start", "relation")


@query("coverage_requests", f"""WITH b AS ({HOUR}){ISLANDS}, q AS (SELECT DISTINCT event_type AS symbol, TIMESTAMP '2024-01-03' + INTERVAL (k) DAY AS want_start, TIMESTAMP '2024-01-03 06:00:00' + INTERVAL (k) DAY AS want_end FROM events, range(20) t(k))
SELECT q.symbol, want_start, want_end, coalesce(bool_or("start" <= want_start AND "end" >= want_end), false) AS covered FROM q LEFT JOIN m USING (symbol) GROUP BY 1, 2, 3""")
def coverage_requests(spark, d):
    found = bars(spark, d)
    at = F.lit("2024-01-03").cast("timestamp_ntz") + F.make_dt_interval(F.col("k"))
    asked = found.select("symbol").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("symbol", at.alias("want_start"), (at + F.expr("interval 6 hours")).alias("want_end"))
    return B.covers(found, asked, ["symbol"])


@query("dedup_bars", f"""WITH a AS ({HOUR}), x AS (SELECT *, 0 AS source FROM a UNION ALL SELECT symbol, "start", "end", open + 1, high + 1, low + 1, "close" + 1, volume, 1 FROM a)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY symbol, "start" ORDER BY source, "end") = 1""")
def dedup_bars(spark, d):
    a = bars(spark, d)
    shifted = a.select("symbol", "start", "end", *[(F.col(c) + 1).alias(c) for c in ("open", "high", "low", "close")], "volume")
    both = a.withColumn("source", F.lit(0)).unionByName(shifted.withColumn("source", F.lit(1)))
    return B.deduplicated(both, F.col("source"))


@query("ohlc_validity", f'{B1} SELECT symbol, "start", low > 0 AND high >= low AND open BETWEEN low AND high AND "close" BETWEEN low AND high AND "end" > "start" AS valid FROM b')
def ohlc_validity(spark, d):
    return bars(spark, d).select("symbol", "start", B.valid_ohlc().alias("valid"))


@query("outline", f"""{B1} SELECT symbol, "start", round(("close" - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0), 9) AS outline FROM b WINDOW w AS (PARTITION BY symbol)""")
def outline(spark, d):
    return B.outline(bars(spark, d)).select("symbol", "start", F.round("outline", 9).alias("outline"))


@query("follow_through", f"""{B1}, f AS (SELECT symbol, arg_min("close", "start") AS base, TIMESTAMP '2024-01-10' AS cutoff FROM b GROUP BY symbol)
SELECT symbol, count(*) AS n_bars, round((arg_max("close", "start") / any_value(base) - 1) * 100, 6) AS close_pct, round((max(high) / any_value(base) - 1) * 100, 6) AS high_pct, round((min(low) / any_value(base) - 1) * 100, 6) AS low_pct
FROM b JOIN f USING (symbol) WHERE "start" >= cutoff GROUP BY symbol""")
def follow_through(spark, d):
    b = bars(spark, d)
    base = b.groupBy("symbol").agg(F.min_by("close", "start").alias("base")).withColumn("cutoff", F.lit("2024-01-10").cast("timestamp_ntz"))
    found = B.follow_through(b, base)
    return found.select("symbol", "n_bars", *[F.round(c, 6).alias(c) for c in ("close_pct", "high_pct", "low_pct")])


@query("tile_index", f"""{B1} SELECT symbol, CAST(floor(epoch_us("start") / 3600000000 / 1000) AS BIGINT) AS tile, count(*) AS n, min("start") AS first FROM b GROUP BY 1, 2""")
def tile_index(spark, d):
    tile = F.floor(interval.seconds_of(F.col("start")) / 3600 / 1000).alias("tile")
    return bars(spark, d).groupBy("symbol", tile).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


@query("cache_missing", f"""{B1}, q AS (SELECT DISTINCT symbol FROM b), e AS (SELECT symbol, TIMESTAMP '2024-01-01' + INTERVAL (k) HOUR AS "start" FROM q, range(700) t(k)),
x AS (SELECT * FROM e ANTI JOIN b USING (symbol, "start")) SELECT symbol, count(*) AS n_missing, min("start") AS fetch_start, max("start") + INTERVAL 1 HOUR AS fetch_end FROM x GROUP BY symbol""")
def cache_missing(spark, d):
    b = bars(spark, d)
    asked = b.select("symbol").distinct().select("symbol", F.lit("2024-01-01").cast("timestamp_ntz").alias("want_start"), F.lit(700).alias("n"))
    return B.cache_missing(b, asked, "1h")


@query("replay_window", """WITH w AS (SELECT event_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 120 HOUR AS "start", least(ts + INTERVAL (event_id % 3000) HOUR, TIMESTAMP '2024-06-01') AS until FROM events),
x AS (SELECT event_id, "start", greatest(time_bucket(INTERVAL 1 HOUR, until), "start" + INTERVAL 1 HOUR) AS "end" FROM w)
SELECT event_id, "start", CASE WHEN "end" > "start" + INTERVAL 2000 HOUR THEN "start" + INTERVAL 2000 HOUR ELSE "end" END AS "end", "end" > "start" + INTERVAL 2000 HOUR AS truncated FROM x""")
def replay_window(spark, d):
    e = load(spark, d, "events")
    horizon = F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 3000).cast("int"))
    shown = B.replay_window(F.col("ts"), F.lit(None).cast("timestamp_ntz"), horizon, F.lit("2024-06-01").cast("timestamp_ntz"), "1h")
    return e.select("event_id", shown.alias("w")).select("event_id", "w.*")


@query("pixel_columns", f"""{B1}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "start") - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, min("close") OVER (PARTITION BY symbol) AS lo, max("close") OVER (PARTITION BY symbol) AS hi FROM b),
x AS (SELECT symbol, "start", CAST(round(i / greatest(n - 1, 1) * 99) AS INTEGER) AS x, round((1 - ("close" - lo) / (hi - lo)) * 50, 6) AS y FROM p)
SELECT symbol, x, y FROM x QUALIFY row_number() OVER (PARTITION BY symbol, x ORDER BY "start") = 1""")
def pixel_columns(spark, d):
    return B.pixel_columns(bars(spark, d), 100, 50).withColumn("y", F.round("y", 6))


@query("trade_sequence_proof", """WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS id, l_shipdate AS moment FROM lineitem),
p AS (SELECT symbol, coalesce(id - lag(id) OVER w = 1, true) AS step, coalesce(moment >= lag(moment) OVER w, true) AS onward FROM t WINDOW w AS (PARTITION BY symbol ORDER BY id))
SELECT symbol, count(*) AS n_trades, bool_and(step) AS contiguous, bool_and(onward) AS ordered, true AS positive FROM p GROUP BY symbol""")
def trade_sequence_proof(spark, d):
    return B.sequence_proof(fills(spark, d))


@query("bounds_maintenance", """SELECT event_type AS symbol, min(CASE WHEN event_id % 3 <> 0 AND (event_id % 2 = 0 OR ts < TIMESTAMP '2024-01-15') THEN ts END) AS first, max(ts + INTERVAL 1 HOUR) AS last FROM events GROUP BY 1""")
def bounds_maintenance(spark, d):
    e = load(spark, d, "events")
    asked = e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 1 hour")).alias("end"), (F.col("event_id") % 3 == 0).alias("complete"), F.when(F.col("event_id") % 2 == 1, F.lit("2024-01-15").cast("timestamp_ntz")).alias("onboarded"))
    return B.bounds(asked)


@query("month_blocks", """WITH l AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, min(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS a, max(year(l_shipdate) * 12 + month(l_shipdate) - 1) AS b FROM lineitem GROUP BY 1),
m AS (SELECT symbol, unnest(range(a, b + 1)) AS m FROM l) SELECT symbol, CAST(m // 5 AS BIGINT) AS block, CAST(min(m) AS INTEGER) AS from_month, CAST(max(m) AS INTEGER) AS to_month FROM m GROUP BY 1, 2""")
def month_blocks(spark, d):
    month = F.year("at") * 12 + F.month("at") - 1
    listing = load(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("at")).groupBy("symbol").agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    return B.month_blocks(listing, 5)


@query("plan_chunks", f"""{B1}, s AS (SELECT symbol, count(*) AS n FROM b GROUP BY symbol), t AS (SELECT symbol, n, (n - 64) // 4 + 1 AS total FROM s WHERE n >= 64),
c AS (SELECT *, unnest(range(0, (total - 1) // 50 + 1)) AS chunk FROM t)
SELECT symbol, chunk, CAST(chunk * 200 AS BIGINT) AS first_bar, CAST(chunk * 200 + 64 + (least(50, total - chunk * 50) - 1) * 4 AS BIGINT) AS end_bar FROM c""")
def plan_chunks(spark, d):
    scopes = bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    return B.plan_chunks(scopes, 64, 4, 50)


@query("window_counts", f"""{B1} SELECT symbol, CAST((CASE WHEN count(*) >= 64 THEN (count(*) - 64) // 16 + 1 ELSE 0 END) + (CASE WHEN count(*) >= 128 THEN (count(*) - 128) // 32 + 1 ELSE 0 END) + (CASE WHEN count(*) >= 256 THEN (count(*) - 256) // 64 + 1 ELSE 0 END) AS BIGINT) AS n FROM b GROUP BY symbol""")
def window_counts(spark, d):
    scopes = bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    return scopes.select("symbol", B.window_count(F.col("n_bars")).alias("n"))


@query("backward_spans", """SELECT event_id, k AS span, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k * 513 + 768) HOUR AS "start", time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k * 513) HOUR AS "end" FROM events, range(8) t(k)""")
def backward_spans(spark, d):
    spans = B.backward_spans(interval.floor(F.col("ts"), "1h"), "1h")
    return load(spark, d, "events").select("event_id", F.posexplode(spans).alias("span", "s")).select("event_id", F.col("span").cast("long").alias("span"), "s.start", "s.end")


@query("month_plan", """SELECT o_orderkey, unnest(range(date_trunc('month', o_orderdate)::TIMESTAMP, o_orderdate + INTERVAL 60 DAY, INTERVAL 1 MONTH))::DATE AS month FROM orders""")
def month_plan(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return o.select("o_orderkey", F.explode(files.month_plan(F.col("at"), F.col("at") + F.expr("interval 60 days"))).alias("month"))


@query("sma_20", f"""{B1} SELECT symbol, "start", CASE WHEN row_number() OVER w >= 20 THEN round(avg("close") OVER (PARTITION BY symbol ORDER BY "start" ROWS 19 PRECEDING), 6) END AS sma FROM b WINDOW w AS (PARTITION BY symbol ORDER BY "start")""")
def sma_20(spark, d):
    return I.sma(bars(spark, d), 20).select("symbol", "start", F.round("sma", 6).alias("sma"))


@query("boll_20", f"""{B1}, s AS (SELECT symbol, "start", row_number() OVER (PARTITION BY symbol ORDER BY "start") AS n, avg("close") OVER f AS m, stddev_pop("close") OVER f AS s FROM b WINDOW f AS (PARTITION BY symbol ORDER BY "start" ROWS 19 PRECEDING))
SELECT symbol, "start", CASE WHEN n >= 20 THEN round(m, 5) END AS middle, CASE WHEN n >= 20 THEN round(m + 2 * s, 5) END AS upper, CASE WHEN n >= 20 THEN round(m - 2 * s, 5) END AS lower FROM s""")
def boll_20(spark, d):
    found = I.bollinger(bars(spark, d), 20, 2.0)
    return found.select("symbol", "start", *[F.round(c, 5).alias(c) for c in ("middle", "upper", "lower")])


TR = """, r AS (SELECT symbol, "start", row_number() OVER w AS n, greatest(high - low, coalesce(abs(high - lag("close") OVER w), 0), coalesce(abs(low - lag("close") OVER w), 0)) AS tr, "close" FROM b WINDOW w AS (PARTITION BY symbol ORDER BY "start"))"""


@query("true_range", f'{B1}{TR} SELECT symbol, "start", round(tr, 9) AS true_range FROM r')
def true_range(spark, d):
    return I.true_range(bars(spark, d)).select("symbol", "start", F.round("true_range", 9).alias("true_range"))


def recursive_sql(value: str, n: int, alpha: float) -> str:
    """SQL of a seeded recursive mean over r (symbol, start, n, ...)."""
    return f"""{B1.replace('WITH', 'WITH RECURSIVE')}{TR}, seed AS (SELECT symbol, avg({value}) AS v FROM r WHERE n <= {n} GROUP BY symbol HAVING count(*) = {n}),
e AS (SELECT symbol, CAST({n} AS BIGINT) AS n, v FROM seed UNION ALL SELECT r.symbol, r.n, e.v + {alpha!r} * (r.{value} - e.v) FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)"""


@query("ema_12", recursive_sql('"close"', 12, 2 / 13) + ' SELECT r.symbol, r."start", round(e.v, 5) AS ema FROM r LEFT JOIN e ON r.symbol = e.symbol AND r.n = e.n')
def ema_12(spark, d):
    return I.ema(bars(spark, d), 12).select("symbol", "start", F.round("ema", 5).alias("ema"))


@query("atr_14", recursive_sql("tr", 14, 1 / 14) + ' SELECT r.symbol, r."start", round(e.v, 5) AS atr FROM r LEFT JOIN e ON r.symbol = e.symbol AND r.n = e.n')
def atr_14(spark, d):
    return I.atr(bars(spark, d), 14).select("symbol", "start", F.round("atr", 5).alias("atr"))


def mean_cte(name: str, source: str, n: int, alpha: float) -> str:
    """CTE of the seeded recursive mean of source (symbol, k from 1 on, x)."""
    return f"""{name}_seed AS (SELECT symbol, avg(x) AS v FROM {source} WHERE k <= {n} GROUP BY symbol HAVING count(*) = {n}),
{name} AS (SELECT symbol, CAST({n} AS BIGINT) AS k, v FROM {name}_seed UNION ALL SELECT s.symbol, s.k, m.v + {alpha!r} * (s.x - m.v) FROM {name} m JOIN {source} s ON s.symbol = m.symbol AND s.k = m.k + 1)"""


CLOSES = f"""{B1.replace('WITH', 'WITH RECURSIVE')}, r AS (SELECT symbol, "start", row_number() OVER (PARTITION BY symbol ORDER BY "start") AS k, "close" AS x FROM b)"""


@query("macd", f"""{CLOSES}, {mean_cte('fast', 'r', 12, 2 / 13)}, {mean_cte('slow', 'r', 26, 2 / 27)},
d AS (SELECT f.symbol, f.k AS place, row_number() OVER (PARTITION BY f.symbol ORDER BY f.k) AS k, f.v - s.v AS x FROM fast f JOIN slow s ON s.symbol = f.symbol AND s.k = f.k), {mean_cte('line', 'd', 9, 2 / 10)}
SELECT r.symbol, r."start", round(d.x, 5) AS dif, round(line.v, 5) AS dea, round(2 * (d.x - line.v), 5) AS hist
FROM r LEFT JOIN d ON d.symbol = r.symbol AND d.place = r.k LEFT JOIN line ON line.symbol = d.symbol AND line.k = d.k""")
def macd(spark, d):
    return I.macd(bars(spark, d)).select("symbol", "start", *[F.round(c, 5).alias(c) for c in ("dif", "dea", "hist")])


@query("rsi_14", f"""{CLOSES}, w AS (SELECT symbol, k - 1 AS k, x - lag(x) OVER (PARTITION BY symbol ORDER BY k) AS c FROM r),
u AS (SELECT symbol, k, greatest(c, 0) AS x FROM w WHERE k > 0), v AS (SELECT symbol, k, greatest(-c, 0) AS x FROM w WHERE k > 0), {mean_cte('up', 'u', 14, 1 / 14)}, {mean_cte('down', 'v', 14, 1 / 14)}
SELECT r.symbol, r."start", round(CASE WHEN down.v = 0 THEN 100 ELSE 100 - 100 / (1 + up.v / down.v) END, 5) AS rsi
FROM r LEFT JOIN up ON up.symbol = r.symbol AND up.k = r.k - 1 LEFT JOIN down ON down.symbol = r.symbol AND down.k = r.k - 1""")
def rsi_14(spark, d):
    return I.rsi(bars(spark, d), 14).select("symbol", "start", F.round("rsi", 5).alias("rsi"))


@query("atr14_settlement")
def atr14_settlement(spark, d):
    return I.atr14_settlement(bars(spark, d, "1d"), F.lit("2024-01-25").cast("timestamp_ntz"))


@query("extremes", f"""{B1} SELECT symbol, max(high) AS high, arg_min("start", (-high, "start")) AS high_at, min(low) AS low, arg_min("start", (low, "start")) AS low_at FROM b GROUP BY symbol""")
def extremes(spark, d):
    return I.extremes(bars(spark, d))


@query("event_windows", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS \"start\", event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = load(spark, d, "events")
    return e.groupBy(F.window("ts", "6 hours").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("tick_lattice", "SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:30:00')) / 1e6 / 900) AS BIGINT) AS slot FROM events")
def tick_lattice(spark, d):
    origin = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    return ticks(spark, d).select(F.col("tick_id").alias("event_id"), interval.bars_between(origin, F.col("at"), "15m").alias("slot"))
