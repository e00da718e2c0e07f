"""Settlement of declared rules: validation, thresholds, triggers, path extremes and verdicts.

Paths are reduced by joins and aggregates; what is left of a claim is one row, which a small decimal
function judges. The stream uses the same function.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbar.functions import interval
from quillbar.functions.decimals import dec, fmt, ratio, times
from quillbar.operators.ordered import extremes, first_reached, micros, moment

STATES = ["realized", "unrealized", "pending", "insufficient_data", "not_triggered", "no_criteria"]
CRITERIA = "struct<version:string,template:string,selected_by:string,direction:string,horizon_hours:int,threshold_ratio:string,atr_multiple:string,invalidation:string,boundary:string,boundary_kind:string,trigger:struct<kind:string,comparator:string,price:string,window_hours:int,interval_seconds:int>>"
DIRECTIONAL = ("T1", "T2", "T3")


def _positive(text: Column) -> Column:
    return F.coalesce(text.try_cast("decimal(38,18)") > 0, F.lit(False))


def error_code(c: Column) -> Column:
    """The first rule a criteria struct breaks, or null."""
    directional = c["template"].isin(*DIRECTIONAL)
    t = c["trigger"]
    bad_trigger = ~t["kind"].isin("bar_close", "trade_touch") | ~t["comparator"].isin("gte", "lte") | ~_positive(t["price"]) | ~t["window_hours"].between(1, 87600) | ((t["kind"] == "bar_close") & (F.coalesce(t["interval_seconds"], F.lit(60)) == 0))
    checks = [
        (~c["version"].eqNullSafe("criteria-v1"), "unknown_rule_version"),
        (c["template"] == "T0", None),
        (~F.coalesce(c["selected_by"].isin("explicit", "default_visible"), F.lit(False)), "criteria_not_selected"),
        (~F.coalesce(c["horizon_hours"].between(1, 87600), F.lit(False)), "invalid_horizon"),
        (directional & ~F.coalesce(c["direction"].isin("L", "S"), F.lit(False)), "direction_missing"),
        (directional & c["threshold_ratio"].isNotNull() & c["atr_multiple"].isNotNull(), "ambiguous_threshold"),
        (directional & c["threshold_ratio"].isNotNull() & ~_positive(c["threshold_ratio"]), "invalid_threshold"),
        (directional & c["atr_multiple"].isNotNull() & ~_positive(c["atr_multiple"]), "invalid_atr_multiple"),
        (c["invalidation"].isNotNull() & ~_positive(c["invalidation"]), "invalid_invalidation"),
        ((c["template"] == "T2") & ~_positive(c["invalidation"]), "invalidation_missing"),
        ((c["template"] == "T4") & (~_positive(c["boundary"]) | ~F.coalesce(c["boundary_kind"].isin("lower_floor", "upper_ceiling"), F.lit(False))), "boundary_missing"),
        ((c["template"] == "T5") & c["atr_multiple"].isNotNull() & ~_positive(c["atr_multiple"]), "invalid_atr_multiple"),
        ((c["template"] == "T3") & t.isNull(), "trigger_missing"),
        ((c["template"] == "T3") & F.coalesce(bad_trigger, F.lit(True)), "invalid_trigger"),
    ]
    out = F
    for condition, code in checks:
        out = out.when(condition, F.lit(code))
    return out.otherwise(F.lit(None).cast("string"))


def threshold(c: dict, base, atr: str | None):
    """Distance that a directional rule asks for; null for others; ValueError(code)."""
    if c["template"] not in DIRECTIONAL:
        return None
    if c.get("threshold_ratio") is not None:
        return times(base, dec(c["threshold_ratio"]))
    return times(_atr(atr), dec(c.get("atr_multiple") or "1"))


def _atr(text: str | None):
    if text is None:
        raise ValueError("atr_missing")
    value = dec(text)
    if value <= 0:
        raise ValueError("invalid_atr")
    return value


@dataclass
class Reduced:
    """A claim's path as one row."""

    criteria: dict
    start: dt.datetime
    evaluated_at: dt.datetime
    base: str
    highest: str
    lowest: str
    covered: bool
    endpoint_proven: bool = True
    atr: str | None = None
    end_price: str | None = None


def verdict(p: Reduced) -> dict:
    """state, reason, mfe, mae, signed_return. The order is the contract: a proven adverse touch first,
    then coverage, thresholds, excursions, time, and the end."""
    none = {"state": "no_criteria", "reason": "no_explicit_criteria", "mfe": None, "mae": None, "signed_return": None}
    c = p.criteria
    if c["template"] == "T0":
        return none
    try:
        return none | _judged(p, c)
    except ValueError as e:
        return none | {"state": "insufficient_data", "reason": str(e)}


def _judged(p: Reduced, c: dict) -> dict:
    base, high, low = dec(p.base), dec(p.highest), dec(p.lowest)
    if base <= 0:
        raise ValueError("invalid_base")
    if p.evaluated_at < p.start:
        raise ValueError("invalid_evaluation_time")
    if high < base or low > base or low <= 0:
        raise ValueError("invalid_aggregate")
    short = c.get("direction") == "S"
    touched = False
    if c.get("invalidation") is not None:
        touched = high >= dec(c["invalidation"]) if short else low <= dec(c["invalidation"])
    if c["template"] == "T4":
        edge = dec(c["boundary"])
        touched = touched or (low <= edge if c["boundary_kind"] == "lower_floor" else high >= edge)
    if touched:
        return {"state": "unrealized", "reason": "boundary_or_invalidation_touched"}
    if not p.covered:
        return {"state": "insufficient_data", "reason": "path_coverage_unproven"}
    wanted = threshold(c, base, p.atr)
    out = {"state": "pending", "reason": "observing"}
    if c["template"] in DIRECTIONAL:
        best, worst = (base - low, base - high) if short else (high - base, low - base)
        out |= {"mfe": fmt(max(ratio(best, base), dec("0"))), "mae": fmt(min(ratio(worst, base), dec("0")))}
    if p.evaluated_at < p.start + dt.timedelta(hours=c["horizon_hours"]):
        return out
    if c["template"] in DIRECTIONAL:
        if not p.endpoint_proven:
            raise ValueError("endpoint_unproven")
        if p.end_price is None:
            raise ValueError("end_price_missing")
        end = dec(p.end_price)
        if end <= 0:
            raise ValueError("invalid_endpoint")
        gained = base - end if short else end - base
        out["signed_return"] = fmt(ratio(gained, base))
        won = gained >= wanted
    elif c["template"] == "T5":
        won = high - low >= times(_atr(p.atr), dec(c.get("atr_multiple") or "1.5"))
    else:
        won = True
    return out | {"state": "realized" if won else "unrealized", "reason": "window_completed"}


def levels(c: dict, base: str, atr: str | None) -> dict:
    """Prices that a chart draws for a rule; they agree with the verdict."""
    b = dec(base)
    wanted = threshold(c, b, atr)
    target = None if wanted is None else fmt(b - wanted if c.get("direction") == "S" else b + wanted)
    return {"threshold": None if wanted is None else fmt(wanted), "target": target, "invalidation": c.get("invalidation"), "boundary": c.get("boundary"), "trigger": (c.get("trigger") or {}).get("price")}


#: Grid by which a search for the first price that reaches a level is narrowed, and by which points are dealt.
STEP = "1d"


def _narrowed(asked: DataFrame, points: DataFrame) -> DataFrame:
    """asked: claim_id, source, symbol, lo, hi, level, up. Each search (lo, hi] becomes two at most: the rest
    of its first interval of the grid, and the first later interval whose extreme reaches the level."""
    bounds = points.groupBy("source", "symbol", interval.floor(F.col("at"), STEP).alias("slot")).agg(F.max("price").alias("_max"), F.min("price").alias("_min"))
    width, tick = F.expr(f"interval {interval.SECONDS[STEP]} seconds"), F.expr("interval 1 microsecond")
    own = interval.floor(F.col("lo"), STEP)
    slots = F.explode(F.sequence(own, interval.floor(F.col("hi"), STEP), width))
    met = asked.where("lo < hi").withColumn("slot", slots).join(bounds, ["source", "symbol", "slot"])
    met = met.where(F.when(F.col("up"), F.col("_max") >= F.col("level")).otherwise(F.col("_min") <= F.col("level")))
    kept = met.groupBy("claim_id", "source", "symbol", "lo", "hi", "level", "up").agg(F.min(F.when(F.col("slot") == own, F.col("slot"))).alias("_own"), F.min(F.when(F.col("slot") > own, F.col("slot"))).alias("_later"))
    slot = kept.withColumn("slot", F.explode(F.array_compact(F.array("_own", "_later"))))
    lo, hi = F.greatest(F.col("lo"), F.col("slot") - tick), F.least(F.col("hi"), F.col("slot") + width - tick)
    return slot.select("claim_id", "source", "symbol", "slot", lo.alias("lo"), hi.alias("hi"), "level", "up")


def first_reaching(asked: DataFrame, points: DataFrame) -> DataFrame:
    """claim_id, trigger_at, trigger_price of the first point of (lo, hi] that reaches the level. Extremes by day
    narrow each search to two days; there points and searches stream by in order, and no search is joined with
    points. points: source, symbol, at, point_id, price."""
    days = _narrowed(asked, points).select("source", "symbol", "slot", F.col("claim_id").alias("question"), micros(F.col("lo")).alias("at"), micros(F.col("hi")).alias("hi"), "level", "up")
    dealt = points.select("source", "symbol", interval.floor(F.col("at"), STEP).alias("slot"), micros(F.col("at")).alias("at"), "point_id", "price")
    found = first_reached(dealt, days, ["source", "symbol", "slot"])
    best = found.groupBy("question").agg(F.min(F.struct("at", "point_id", "price")).alias("first"))
    return best.select(F.col("question").alias("claim_id"), moment(F.col("first.at")).alias("trigger_at"), F.col("first.price").alias("trigger_price"))


def triggers(claims: DataFrame, trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Start and base of each T3 claim's horizon: the base itself, the first trade in (start, expiry] or
    the first bar of the exact length that ends there, whichever the rule names. claims: claim_id,
    symbol, start, evaluated_at, base (double), criteria."""
    t = F.col("criteria")["trigger"]
    expiry = F.col("start") + F.make_dt_interval(F.lit(0), t["window_hours"])
    level, up, touch = t["price"].cast("double"), t["comparator"] == "gte", t["kind"] == "trade_touch"
    # Trades are one source of points; bars of each length in seconds are others.
    source = F.when(touch, 0.0).otherwise(F.coalesce(t["interval_seconds"], F.lit(60)).cast("double"))
    waiting = claims.where((F.col("criteria")["template"] == "T3") & t["kind"].isin("trade_touch", "bar_close"))
    asked = waiting.select("claim_id", "symbol", "base", touch.alias("touch"), source.alias("source"), F.col("start").alias("lo"), F.least(expiry, F.col("evaluated_at")).alias("hi"), level.alias("level"), up.alias("up"))
    reached = F.col("touch") & F.when(F.col("up"), F.col("base") >= F.col("level")).otherwise(F.col("base") <= F.col("level"))
    at_once = asked.where(reached).select("claim_id", F.col("lo").alias("trigger_at"), F.col("base").alias("trigger_price"))
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1_000_000
    points = trades.select(F.lit(0.0).alias("source"), "symbol", "at", F.col("tick_id").alias("point_id"), "price")
    points = points.unionByName(bars.select(seconds.alias("source"), "symbol", F.col("end").alias("at"), F.lit(0).cast("long").alias("point_id"), F.col("close").alias("price")))
    return at_once.unionByName(first_reaching(asked.where(~F.coalesce(reached, F.lit(False))), points))


def traded(claims: DataFrame, trades: DataFrame) -> DataFrame:
    """claim_id, most, least of the trades (symbol, at, price) after start and not after through; claims without any have no row.
    A day is one row with the extremes of its 24 hours, so a claim meets its days once each, and whole hours count by slices of them; what
    is left of the first and last hour is asked while the trades of an hour stream by. The days are no small side by the size of
    the claims' file, so their join is one by shuffle: claims dealt to days are never broadcast."""
    grid = lambda c, step: interval.floor(F.col(c), step)
    known = trades.where("price is not null").select("symbol", "at", grid("at", "1h").alias("_hour"), F.col("price").cast("double").alias("price"))
    hours = known.groupBy("symbol", "_hour").agg(F.max("price").alias("most"), F.min("price").alias("least"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct(F.hour("_hour"), c)))
    days = hours.groupBy("symbol", grid("_hour", "1d").alias("_day")).agg(entry("most").alias("_most"), entry("least").alias("_least"))
    by_hour = lambda c: F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.get(F.map_values(F.map_filter(c, lambda k, _: k == h)), F.lit(0))).alias(c)
    days = days.select("symbol", "_day", by_hour("_most"), by_hour("_least"))
    day, hour, tick = F.expr("interval 1 day"), F.expr("interval 1 hour"), F.expr("interval 1 microsecond")
    asked = claims.where("start < through").select("claim_id", "symbol", "start", "through")
    spread = asked.withColumn("_day", F.explode(F.sequence(grid("start", "1d"), grid("through", "1d"), day)))
    # Hours begin after the start and end by the end of the claim.
    first = F.when(F.col("_day") > F.col("start"), 0).otherwise(F.hour("start") + 1)
    over = F.when(F.col("_day") + day - tick <= F.col("through"), 24).otherwise(F.hour(F.col("through") + tick))
    some = spread.withColumn("_first", first).withColumn("_n", over - F.col("_first")).where("_n > 0").select("claim_id", "symbol", "_day", "_first", "_n")
    cut = lambda c: F.slice(c, F.col("_first") + 1, F.col("_n"))
    whole = some.join(days.hint("merge"), ["symbol", "_day"]).select("claim_id", F.array_max(cut("_most")).alias("most"), F.array_min(cut("_least")).alias("least")).where("most is not null")
    edges = asked.withColumn("_hour", F.explode(F.array_distinct(F.array(grid("start", "1h"), grid("through", "1h")))))
    left = edges.where((F.col("_hour") <= F.col("start")) | (F.col("_hour") + hour - tick > F.col("through")))
    left = left.select("symbol", "_hour", F.col("claim_id").alias("question"), micros(F.greatest(F.col("start"), F.col("_hour") - tick)).alias("at"), micros(F.least(F.col("through"), F.col("_hour") + hour - tick)).alias("hi"))
    points = known.select("symbol", "_hour", micros(F.col("at")).alias("at"), F.lit(0).cast("long").alias("point_id"), "price")
    single = extremes(points, left, ["symbol", "_hour"]).select(F.col("question").alias("claim_id"), "most", "least")
    return whole.unionByName(single).groupBy("claim_id").agg(F.max("most").alias("most"), F.min("least").alias("least"))


def paths(claims: DataFrame, bars: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """Highest, lowest, first bar at the threshold and whether a bar crosses an edge, of the bars within
    (start, through] of each claim; trades (symbol, at, price) there extend the extremes. claims: claim_id,
    symbol, start, through, base, direction, distance.

    Days that lie inside a claim whole count by their extremes; single bars are met on its first and last
    days, and on the first whole day that reaches the threshold."""
    day = lambda c: F.date_trunc("day", F.col(c).cast("timestamp")).cast("timestamp_ntz")
    b = bars.select("symbol", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("high").alias("_h"), F.col("low").alias("_l")).withColumn("_day", day("_s"))
    days = b.groupBy("symbol", "_day").agg(F.max("_h").alias("_h"), F.min("_l").alias("_l"), F.count(F.lit(1)).alias("_n"), F.max("_e").alias("_last"))
    longest = F.broadcast(b.agg(F.max(F.unix_micros(F.col("_e").cast("timestamp")) - F.unix_micros(F.col("_s").cast("timestamp"))).alias("_longest")))  # one row
    early = F.timestamp_micros(F.unix_micros(F.col("start").cast("timestamp")) - F.coalesce("_longest", F.lit(0))).cast("timestamp_ntz")
    spread = claims.crossJoin(longest).withColumn("_early", early).where("_early <= through")
    spread = spread.withColumn("_day", F.explode(F.sequence(day("_early"), day("through"), F.expr("interval 1 day")))).drop("_early", "_longest")
    gained = F.when(F.col("direction") == "S", F.col("base") - F.col("_l")).otherwise(F.col("_h") - F.col("base"))
    met = spread.join(days, ["symbol", "_day"])
    whole = (F.col("_day") >= F.col("start")) & (F.col("_last") <= F.col("through"))
    nothing = F.lit(None).cast("timestamp_ntz")
    full = met.where(whole).groupBy("claim_id").agg(F.max("_h").alias("h"), F.min("_l").alias("l"), F.sum("_n").alias("n"), F.min(F.when(gained >= F.col("distance"), F.col("_day"))).alias("_first"))
    single = met.where(~whole).select(*claims.columns, "_day").join(b, ["symbol", "_day"]).where((F.col("_e") > F.col("start")) & (F.col("_s") < F.col("through")))
    inside = (F.col("_s") >= F.col("start")) & (F.col("_e") <= F.col("through"))
    parts = single.groupBy("claim_id").agg(
        F.max(F.when(inside, F.col("_h"))).alias("h"),
        F.min(F.when(inside, F.col("_l"))).alias("l"),
        F.count_if(inside).alias("n"),
        F.min(F.when(inside & (gained >= F.col("distance")), F.col("_s"))).alias("at"),
        F.bool_or(~inside).alias("crossed"),
    )
    reaching = claims.join(full.where("_first is not null").select("claim_id", F.col("_first").alias("_day")), "claim_id").join(b, ["symbol", "_day"])
    reaching = reaching.where(gained >= F.col("distance")).groupBy("claim_id").agg(F.min("_s").alias("at"))
    none, zero, no = F.lit(None).cast(b.schema["_h"].dataType), F.lit(0).cast("long"), F.lit(False)
    every = parts.unionByName(full.select("claim_id", "h", "l", "n", nothing.alias("at"), no.alias("crossed")))
    every = every.unionByName(reaching.select("claim_id", none.alias("h"), none.alias("l"), zero.alias("n"), "at", no.alias("crossed")))
    if trades is not None:
        seen = traded(claims, trades)
        every = every.unionByName(seen.select("claim_id", F.col("most").alias("h"), F.col("least").alias("l"), zero.alias("n"), nothing.alias("at"), no.alias("crossed")))
    found = every.groupBy("claim_id").agg(F.max("h").alias("h"), F.min("l").alias("l"), F.min("at").alias("threshold_at"), F.sum("n").alias("n_bars"), F.bool_or("crossed").alias("crossed"))
    out = claims.join(found, "claim_id", "left")
    return out.select("claim_id", F.greatest("base", F.coalesce("h", "base")).alias("highest"), F.least("base", F.coalesce("l", "base")).alias("lowest"), "threshold_at", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), F.coalesce("crossed", F.lit(False)).alias("crossed"))


RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("state", "reason", "mfe", "mae", "signed_return")])
#: Numbers of up to ten digits before the point and six after it are judged as Spark decimals, whose sums, products and ratios
#: are exact there; verdict() judges rows that hold longer ones.
SHORT = r"^-?[0-9]{1,10}(\.[0-9]{1,6})?$"


@F.pandas_udf(RESULT)
def judged(criteria: pd.DataFrame, start: pd.Series, evaluated: pd.Series, prices: pd.DataFrame, covered: pd.Series, proven: pd.Series) -> pd.DataFrame:
    """verdict() of reduced rows, nulls where the template is null; prices: base, highest, lowest, atr, end_price as text."""
    out = pd.DataFrame(None, index=range(len(start)), columns=RESULT.names, dtype=object)
    asked = criteria["template"].notna().to_numpy().nonzero()[0]
    known = lambda pdf: pdf.iloc[asked].astype(object).where(pdf.iloc[asked].notna(), None).to_dict("records")
    for i, c, p in zip(asked.tolist(), known(criteria.drop(columns="trigger")), known(prices), strict=True):
        c["horizon_hours"] = None if c["horizon_hours"] is None else int(c["horizon_hours"])
        found = verdict(Reduced(c, start.iloc[i].to_pydatetime(), evaluated.iloc[i].to_pydatetime(), p["base"], p["highest"], p["lowest"], bool(covered.iloc[i]), bool(proven.iloc[i]), p["atr"], p["end_price"]))
        out.iloc[i] = [found[n] for n in RESULT.names]
    return out


def _with_ratios(df: DataFrame, pairs: dict[str, Column], by: Column) -> DataFrame:
    """df with, for each name, its column / by (decimal(18,6), by positive) as text, rounded half to even at twelve places."""
    whole = lambda x: (x * 1_000_000).cast("decimal(18,0)")
    least, one = F.col("_by").cast("decimal(38,0)"), F.lit(10**12).cast("decimal(13,0)")
    df = df.withColumn("_by", whole(by)).withColumns({f"_most{n}": (whole(F.abs(x)) * one).cast("decimal(38,0)") for n, x in pairs.items()})
    df = df.withColumns({f"_rest{n}": F.col(f"_most{n}") % least for n in pairs})
    df = df.withColumns({f"_times{n}": ((F.col(f"_most{n}") - F.col(f"_rest{n}")) / least).cast("decimal(38,0)") for n in pairs})
    up = lambda n: (2 * F.col(f"_rest{n}") > least) | ((2 * F.col(f"_rest{n}") == least) & (F.col(f"_times{n}") % 2 == 1))
    df = df.withColumns({f"_text{n}": (F.col(f"_times{n}") + F.when(up(n), 1).otherwise(0)).cast("decimal(38,0)").cast("string") for n in pairs})
    sign = lambda x: F.when(x < 0, "-").otherwise("")
    # A number of at least thirteen digits, its point before the last twelve, without what says nothing.
    digits = lambda n: F.lpad(f"_text{n}", F.greatest(F.length(f"_text{n}"), F.lit(13)), F.lit("0"))
    return df.withColumns({n: F.when(F.col(f"_text{n}") == "0", "0").otherwise(F.concat(sign(x), F.regexp_replace(F.regexp_replace(digits(n), r"(\d{12})$", ".$1"), r"\.?0*$", ""))) for n, x in pairs.items()})


def _with_verdict(df: DataFrame, c: Column) -> DataFrame:
    """df with `_v`: verdict() as a column, of rows where `_short`. Numbers, ratios and the result are projections of their own, so that
    none is written out twice."""
    short = lambda text: F.when(F.col("_short") & F.col("_code").isNull(), text).try_cast("decimal(18,6)")
    wide = lambda x: x.cast("decimal(38,12)")
    given = {"base": F.col("base"), "high": F.col("highest"), "low": F.col("lowest"), "end": F.col("end_price"), "atr": F.col("atr"), "out": c["invalidation"], "edge": c["boundary"], "share": c["threshold_ratio"], "multiple": F.coalesce(c["atr_multiple"], F.when(c["template"] == "T5", "1.5").otherwise("1"))}
    df = df.withColumns({f"_{n}": short(text) for n, text in given.items()})
    base, high, low, end, atr, out_of, edge, share, multiple = (F.col(f"_{n}") for n in given)
    selling, directional = F.coalesce(c["direction"] == "S", F.lit(False)), c["template"].isin(*DIRECTIONAL)
    df = df.withColumns({"_best": F.when(selling, base - low).otherwise(high - base), "_worst": F.when(selling, base - high).otherwise(low - base), "_gained": F.when(selling, base - end).otherwise(end - base)})
    told = F.when(directional & (base > 0), base)
    df = _with_ratios(df, {"_mfe": F.col("_best"), "_mae": F.col("_worst"), "_gain": F.col("_gained")}, told)
    touched = F.coalesce(F.when(selling, high >= out_of).otherwise(low <= out_of), F.lit(False))
    touched = touched | F.coalesce((c["template"] == "T4") & F.when(c["boundary_kind"] == "lower_floor", low <= edge).otherwise(high >= edge), F.lit(False))
    by_ratio = directional & c["threshold_ratio"].isNotNull()
    wanted = F.when(by_ratio, wide(base * share)).otherwise(wide(atr * multiple))
    bad_atr = F.when(F.col("atr").isNull(), "atr_missing").when(atr <= 0, "invalid_atr")
    won = F.when(directional, wide(F.col("_gained")) >= wanted).when(c["template"] == "T5", wide(high - low) >= wanted).otherwise(True)
    over = F.col("evaluated_at") >= F.col("start") + F.make_dt_interval(F.lit(0), c["horizon_hours"])
    # In the order of the contract; a reason alone means that data are insufficient.
    steps = [
        (c["template"] == "T0", "no_explicit_criteria"),
        (base <= 0, "invalid_base"),
        (F.col("evaluated_at") < F.col("start"), "invalid_evaluation_time"),
        ((high < base) | (low > base) | (low <= 0), "invalid_aggregate"),
        (touched, "boundary_or_invalidation_touched"),
        (~F.col("covered"), "path_coverage_unproven"),
        (directional & ~by_ratio & bad_atr.isNotNull(), bad_atr),
        (~over, "observing"),
        (directional & ~F.col("endpoint_proven"), "endpoint_unproven"),
        (directional & F.col("end_price").isNull(), "end_price_missing"),
        (directional & (end <= 0), "invalid_endpoint"),
        ((c["template"] == "T5") & bad_atr.isNotNull(), bad_atr),
    ]
    reason = F
    for condition, value in steps:
        reason = reason.when(condition, value)
    df = df.withColumns({"_reason": reason.otherwise("window_completed"), "_won": won})
    ends = {"no_explicit_criteria": "no_criteria", "boundary_or_invalidation_touched": "unrealized", "observing": "pending"}
    state = F.when(F.col("_reason") == "window_completed", F.when(F.col("_won"), "realized").otherwise("unrealized"))
    for code, name in ends.items():
        state = state.when(F.col("_reason") == code, name)
    seen, done = F.col("_reason").isin("observing", "window_completed"), F.col("_reason") == "window_completed"
    return df.withColumn("_v", F.struct(state.otherwise("insufficient_data").alias("state"), F.col("_reason").alias("reason"), F.when(seen, F.col("_mfe")).alias("mfe"), F.when(seen, F.col("_mae")).alias("mae"), F.when(done, F.col("_gain")).alias("signed_return")))


def settle(reduced: DataFrame) -> DataFrame:
    """Outcomes of claims whose paths are reduced: claim_id, criteria, start, evaluated_at, base, highest,
    lowest, atr, end_price (text), covered, endpoint_proven. Other columns are kept."""
    c = F.col("criteria")
    numbers = [F.col(n) for n in ("base", "highest", "lowest", "atr", "end_price")] + [c[n] for n in ("threshold_ratio", "atr_multiple", "invalidation", "boundary")]
    plain = F.col("base").isNotNull() & F.col("highest").isNotNull() & F.col("lowest").isNotNull()
    for n in numbers:
        plain = plain & F.coalesce(n.rlike(SHORT), F.lit(True))
    prices = F.struct("base", "highest", "lowest", "atr", "end_price")
    found = reduced.withColumn("_code", error_code(c)).withColumn("_short", F.col("_code").isNotNull() | plain)
    # Rows that Spark's decimals judge go through the function as nulls.
    found = found.withColumn("_r", judged(F.when(~F.col("_short"), c), F.col("start"), F.col("evaluated_at"), F.when(~F.col("_short"), prices), F.col("covered"), F.col("endpoint_proven")))
    found = _with_verdict(found, c)
    bad = F.col("_code").isNotNull()
    pick = lambda f: F.when(bad, None).when(F.col("_short"), F.col("_v")[f]).otherwise(F.col("_r")[f])
    taken = {"criteria", "start", "evaluated_at", "base", "highest", "lowest", "atr", "end_price", "covered", "endpoint_proven", "claim_id"}
    rest = [F.col(f"`{x}`") for x in reduced.columns if x not in taken]
    return found.select("claim_id", *rest, F.when(bad, "no_criteria").otherwise(pick("state")).alias("state"), F.when(bad, F.col("_code")).otherwise(pick("reason")).alias("reason"), pick("mfe").alias("mfe"), pick("mae").alias("mae"), pick("signed_return").alias("signed_return"))


def outcome_heads(outcomes: DataFrame) -> DataFrame:
    """The outcome of each claim that no other supersedes; the latest revision if several."""
    replaced = outcomes.where("supersedes is not null").select(F.col("supersedes").alias("outcome_id"))
    left = outcomes.join(replaced, "outcome_id", "left_anti")
    return left.groupBy("call_id", "claim_no").agg(F.max_by(F.struct("outcome_id", "state"), "revision").alias("h")).select("call_id", "claim_no", "h.*")


def replayed(outcomes: DataFrame, previews: DataFrame) -> DataFrame:
    """outcomes with replays of rules appended as kind `rule_replay`: one for each claim and digest of input
    and result, however often it is replayed; they are no formal samples. previews: call_id, claim_no, input
    (text), result (text)."""
    digest = F.sha2(F.concat_ws("\x1f", "input", "result"), 256)
    fresh = previews.select("call_id", "claim_no", F.lit("rule_replay").alias("kind"), "result", digest.alias("digest")).dropDuplicates(["call_id", "claim_no", "digest"])
    known = outcomes.where("kind = 'rule_replay'").select("call_id", "claim_no", "digest")
    return outcomes.unionByName(fresh.join(known, ["call_id", "claim_no", "digest"], "left_anti").select(*outcomes.columns))
