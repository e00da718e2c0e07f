"""Bars and coverage: gaps, proofs, merges of half-open intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.functions import interval
from quillbar.operators.relational import asof


def gaps(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """key, gap_start, gap_end of the holes between neighbouring bars."""
    before = F.lag("end").over(W.partitionBy(key).orderBy("start"))
    return bars.withColumn("gap_start", before).where(F.col("gap_start") < F.col("start")).select(key, "gap_start", F.col("start").alias("gap_end"))


def coverage_proof(bars: DataFrame, start: Column, end: Column, key: str = "symbol") -> DataFrame:
    """Whether the bars of each key cover [start, end) without hole."""
    before = F.lag("end").over(W.partitionBy(key).orderBy("start"))
    inside = bars.where((F.col("start") >= start) & (F.col("end") <= end)).withColumn("_touch", F.coalesce(before == F.col("start"), F.lit(True)))
    return inside.groupBy(key).agg(F.count(F.lit(1)).alias("n_bars"), ((F.min("start") == start) & (F.max("end") == end) & F.every("_touch")).alias("complete"))


def contiguity(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Relation of each bar to the one before: first, contiguous, overlap or gap."""
    before = F.lag("end").over(W.partitionBy(key).orderBy("start"))
    kind = F.when(before.isNull(), "first").when(before == F.col("start"), "contiguous").when(before > F.col("start"), "overlap").otherwise("gap")
    return bars.withColumn("relation", kind)


def merged(intervals: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """Union of half-open intervals: overlapping, nested and touching ones become one; `latest`: column
    whose greatest value is kept."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    island = F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    found = intervals.withColumn("_fresh", fresh).withColumn("_island", island)
    extra = [F.max(latest).alias(latest)] if latest else []
    return found.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra).drop("_island")


def missing(intervals: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """What the union of the intervals leaves uncovered of [start, end), for each key that has any."""
    clipped = intervals.select(*keys, F.greatest("start", start).alias("start"), F.least("end", end).alias("end")).where("start < end")
    edge = intervals.select(*keys).distinct().select(*keys, start.alias("start"), start.alias("end"))
    last = intervals.select(*keys).distinct().select(*keys, end.alias("start"), end.alias("end"))
    islands = merged(clipped.unionByName(edge).unionByName(last), keys)
    after = F.lead("start").over(W.partitionBy(*keys).orderBy("start"))
    return islands.select(*keys, F.col("end").alias("start"), after.alias("end")).where("start < end")


def covers(intervals: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct requests (keys, want_start, want_end) with whether one island of the intervals contains them:
    islands are apart, so only the last one that starts by then can. One as-of pass, no pairs."""
    islands = merged(intervals, keys).select(*keys, F.col("start").alias("want_start"), F.col("end").alias("_until"))
    met = asof(requests.distinct(), islands, keys, "want_start", ["_until"])
    covered = F.coalesce(F.col("_until") >= F.col("want_end"), F.lit(False))
    return met.select(*requests.columns, covered.alias("covered"))


def deduplicated(bars: DataFrame, priority: Column, keys: tuple[str, ...] = ("symbol", "start")) -> DataFrame:
    """One bar a start; the least priority wins."""
    order = W.partitionBy(*keys).orderBy(priority, "end")
    return bars.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def valid_ohlc() -> Column:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    finite = F.forall(F.array(o, h, low, c), lambda x: ~F.isnan(x.cast("double")) & (x.cast("double") < float("inf")))
    return finite & (low > 0) & (h >= low) & o.between(low, h) & c.between(low, h) & (F.col("end") > F.col("start"))


def sequence_proof(trades: DataFrame, key: str = "symbol", number: str = "trade_id") -> DataFrame:
    """For each key: ids rise by one, time does not fall, all on one day, price and quantity positive."""
    order = W.partitionBy(key).orderBy(number)
    step = F.coalesce(F.col(number) - F.lag(number).over(order) == 1, F.lit(True))
    onward = F.coalesce(F.col("at") >= F.lag("at").over(order), F.lit(True))
    checked = trades.withColumn("_step", step).withColumn("_onward", onward)
    return checked.groupBy(key).agg(F.count(F.lit(1)).alias("n_trades"), F.every("_step").alias("contiguous"), F.every("_onward").alias("ordered"), F.every((F.col("price") > 0) & (F.col("quantity") > 0)).alias("positive"))


def outline(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Each close between the least low (0) and the greatest high (1) of its key; null if flat."""
    whole = W.partitionBy(key)
    low, high = F.min("low").over(whole), F.max("high").over(whole)
    return bars.withColumn("outline", F.try_divide(F.col("close") - low, F.nullif(high - low, F.lit(0.0))))


def follow_through(bars: DataFrame, base: DataFrame, key: str = "symbol") -> DataFrame:
    """After each key's cutoff: number of bars, and last close, greatest high, least low in per cent of
    base. base: key, cutoff, base."""
    after = bars.join(base, key).where(F.col("start") >= F.col("cutoff"))
    change = lambda x: (x / F.first("base") - 1) * 100
    return after.groupBy(key).agg(F.count(F.lit(1)).alias("n_bars"), change(F.max_by("close", "start")).alias("close_pct"), change(F.max("high")).alias("high_pct"), change(F.min("low")).alias("low_pct"))


def bounds(requests: DataFrame, key: str = "symbol") -> DataFrame:
    """first, last of all requests of a key: the earliest start that is known to be its first bar, and
    the latest end. requests: key, start, end, complete, onboarded."""
    first = F.when(~F.col("complete") & (F.col("onboarded").isNull() | (F.col("start") < F.col("onboarded"))), F.col("start"))
    return requests.groupBy(key).agg(F.min(first).alias("first"), F.max("end").alias("last"))


def cache_missing(cached: DataFrame, requests: DataFrame, step: str, key: str = "symbol") -> DataFrame:
    """Expected bar starts of each request (key, want_start, n) that are not cached, as one range to
    fetch from the first to the last of them."""
    numbers = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    expected = requests.select(key, "want_start", numbers.alias("i")).select(key, interval.add_bars(F.col("want_start"), F.col("i"), step).alias("start"))
    absent = expected.join(cached.select(key, "start"), [key, "start"], "left_anti")
    return absent.groupBy(key).agg(F.count(F.lit(1)).alias("n_missing"), F.min("start").alias("fetch_start"), interval.add_bars(F.max("start"), F.lit(1), step).alias("fetch_end"))


def replay_window(judged: Column, located: Column, horizon: Column, now: Column, step: str, back: int = 120, most: int = 2000) -> Column:
    """start, end and truncated of the bars shown for one call."""
    start = F.coalesce(located, interval.add_bars(interval.floor(judged, step), F.lit(-back), step))
    end = interval.floor(F.least(horizon, now), step)
    end = F.greatest(end, interval.add_bars(start, F.lit(1), step))
    n = interval.bars_between(start, end, step)
    return F.struct(start.alias("start"), F.when(n > most, interval.add_bars(start, F.lit(most), step)).otherwise(end).alias("end"), (n > most).alias("truncated"))


def pixel_columns(bars: DataFrame, width: int, height: int, key: str = "symbol") -> DataFrame:
    """First close of each pixel column, scaled to the height."""
    whole = W.partitionBy(key)
    place = F.row_number().over(whole.orderBy("start")) - 1
    n = F.count(F.lit(1)).over(whole)
    x = F.round(place / F.greatest(n - 1, F.lit(1)) * (width - 1)).cast("int")
    low, high = F.min("close").over(whole), F.max("close").over(whole)
    y = F.coalesce((F.lit(1.0) - F.try_divide(F.col("close") - low, F.nullif(high - low, F.lit(0.0)))) * height, F.lit(height / 2))
    drawn = bars.select(key, "start", x.alias("x"), y.alias("y"))
    return drawn.withColumn("_n", F.row_number().over(W.partitionBy(key, "x").orderBy("start"))).where("_n = 1").select(key, "x", "y")


def month_blocks(listing: DataFrame, months: int) -> DataFrame:
    """Blocks of months on an absolute grid, clipped to each symbol's first and last month.
    listing: symbol, first_month, last_month (months since year 0)."""
    each = listing.select("symbol", F.explode(F.sequence("first_month", "last_month")).alias("m"))
    return each.groupBy("symbol", F.floor(F.col("m") / months).alias("block")).agg(F.min("m").alias("from_month"), F.max("m").alias("to_month"))


def window_count(n_bars: Column, sizes: tuple[int, ...] = (64, 128, 256)) -> Column:
    """Upper bound of the windows of all sizes, at a stride of a quarter of the size."""
    return sum((F.when(n_bars >= w, F.floor((n_bars - w) / (w // 4)) + 1).otherwise(0) for w in sizes), F.lit(0)).cast("long")


def plan_chunks(scopes: DataFrame, window: int, stride: int, starts: int = 512) -> DataFrame:
    """scopes (symbol, n_bars) cut into runs of at most `starts` window starts; shorter ones are skipped."""
    total = F.floor((F.col("n_bars") - window) / stride) + 1
    chunks = scopes.where(F.col("n_bars") >= window).withColumn("_total", total)
    chunks = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_total") - 1) / starts))))
    n = F.least(F.lit(starts), F.col("_total") - F.col("chunk") * starts)
    first = F.col("chunk") * (starts * stride)
    return chunks.select("symbol", "chunk", first.cast("long").alias("first_bar"), (first + window + (n - 1) * stride).cast("long").alias("end_bar"))


def backward_spans(end: Column, step: str, window: int = 256, overlap: int = 255, most: int = 8) -> Column:
    """Spans of three windows that go back from `end`, each sharing `overlap` bars with the next."""
    span = 3 * window
    at = lambda i: interval.add_bars(end, -(i * (span - overlap)), step)
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.struct(interval.add_bars(end, -(i * (span - overlap) + span), step).alias("start"), at(i).alias("end")))


#: Intervals among which the level of detail is chosen, and pixels of a bar that is neither too
#: dense nor too sparse.
LADDER = ("1m", "5m", "15m", "1h", "4h", "1d", "1w")
DENSE, SPARSE, COMFORT = 2.0, 14.0, 6.0


def ladder_for(own: str) -> list[str]:
    """LADDER with the record's own interval in its place."""
    steps = set(LADDER) | ({own} if own in interval.LEAST_SECONDS else set())
    return sorted(steps, key=lambda s: interval.LEAST_SECONDS[s])


def level_of_detail(width: Column, seconds: Column, current: Column, base: str | None = None, comfort: float = COMFORT) -> Column:
    """Interval whose bars of a span of `seconds` on `width` pixels are comfortable: the current one while its
    bars are; else, of those that fit, the nearest to the base (or to the comfortable density), and where none
    fits, the one of nearest density."""
    steps = ladder_for(base or LADDER[0])
    pixels = lambda s: width * interval.LEAST_SECONDS[s] / seconds
    fits = lambda s: pixels(s).between(DENSE, SPARSE)
    ranked = []
    for place, s in enumerate(steps):
        off = F.abs(F.log(pixels(s) / comfort))
        near = F.lit(abs(math.log(interval.LEAST_SECONDS[s] / interval.LEAST_SECONDS[base]))) if base else off
        ranked.append(F.struct(F.when(fits(s), near).otherwise(off + 10).alias("rank"), F.lit(place).alias("place"), F.lit(s).alias("step")))
    stays = F.lit(False)
    for s in steps:
        stays = stays | ((current == s) & fits(s))
    usable = (width > 0) & (seconds > 0)
    return F.when(~F.coalesce(usable, F.lit(False)) | stays, current).otherwise(F.array_min(F.array(*ranked))["step"])


def next_level(current: Column, pixels: Column, steps: list[str]) -> Column:
    """One step coarser where bars are too dense, one finer where they are too sparse."""
    names = F.array(*[F.lit(s) for s in steps])
    at = F.array_position(names, current)  # from 1; 0: not on the ladder
    moved = F.when((pixels < DENSE) & (at > 0), F.get(names, at.cast("int"))).when((pixels > SPARSE) & (at > 1), F.get(names, (at - 2).cast("int")))
    return F.coalesce(moved, current)


def compared_outline(bars: DataFrame, outlines: DataFrame, key: str = "symbol") -> DataFrame:
    """A drawn outline (values from 0 to 1) over the bars that end by the cutoff: positions and amplitudes are
    mapped linearly onto them, so later bars cannot change the fit. outlines: key, values, cutoff. Fewer than two
    values or bars, values outside 0 to 1 and flat bars give no row."""
    good = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0)) & (F.size("values") >= 2)
    matched = bars.select(key, "start", "end", "high", "low").join(outlines.where(good), key).where(F.col("end") <= F.col("cutoff"))
    whole = W.partitionBy(key, "cutoff")
    n, place = F.count(F.lit(1)).over(whole), F.row_number().over(whole.orderBy("start")) - 1
    low, high = F.min("low").over(whole), F.max("high").over(whole)
    placed = matched.select(key, "cutoff", "start", "values", n.alias("_n"), place.alias("_i"), low.alias("_low"), high.alias("_high")).where("_n >= 2 and _high > _low")
    position = F.col("_i") * (F.size("values") - 1) / (F.col("_n") - 1)
    before = F.floor(position).cast("int")
    mix = position - before
    value = F.get("values", before) * (1 - mix) + F.get("values", F.least(before + 1, F.size("values") - 1)) * mix
    return placed.select(key, "cutoff", "start", (F.col("_low") + value * (F.col("_high") - F.col("_low"))).alias("value"))


def lattice(view_start: Column, view_end: Column, step: Column, anchor: Column, cap: int) -> Column:
    """(origin, count) of a grid of slots that covers the view and two spans on both sides, in phase with the
    anchor; beyond `cap` slots it is centred on the view. Times and step are seconds."""
    span = F.greatest(step, view_end - view_start)
    phase = F.pmod(anchor, step)
    aligned = lambda x: F.floor((x - phase) / step) * step + phase
    origin = aligned(view_start - 2 * span)
    count = F.floor((view_end + 2 * span - origin) / step) + 1
    centred = aligned((view_start + view_end) / 2 - step * (cap / 2))
    return F.struct(F.when(count > cap, centred).otherwise(origin).cast("long").alias("origin"), F.least(count, F.lit(cap)).cast("long").alias("count"))


def slot_of(at: Column, grid: Column, step: Column) -> Column:
    """Slot of a bar's time in a lattice, null outside it."""
    slot = F.round((at - grid["origin"]) / step).cast("long")
    return F.when(slot.between(0, grid["count"] - 1), slot)


def page_of(bars: DataFrame, start: Column, end: Column, now: Column, key: str = "symbol", most: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(bars wholly inside [start, end) and closed by now, the others that touch it: incomplete or on the edge).
    More than `most` a key fail the job."""
    touching = bars.where((F.col("start") < end) & (F.col("end") > start))
    whole = (F.col("start") >= start) & (F.col("end") <= end) & (F.col("end") <= now)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    checked = touching.withColumn("_n", n).where(F.when(F.col("_n") <= most, True).otherwise(F.raise_error(F.lit("page_too_long")).cast("boolean"))).drop("_n")
    return checked.where(whole), checked.where(~whole)


def in_bounds(requests: DataFrame, known: DataFrame, listing: DataFrame, key: str = "symbol") -> DataFrame:
    """Requests with what is known of their key: first and last bar, and when it was listed and delisted."""
    return requests.join(known, key, "left").join(listing, key, "left")
