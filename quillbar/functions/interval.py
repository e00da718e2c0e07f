"""Bar intervals: grid floor and ceiling, and counting in bars, as column expressions.

Columns are timestamps without zone, read as UTC.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbar.functions.binding import once

MINUTE, HOUR, DAY = 60, 3600, 86400
#: Name -> seconds (None: calendar month).
SECONDS = {"1m": MINUTE, "3m": 3 * MINUTE, "5m": 5 * MINUTE, "15m": 15 * MINUTE, "30m": 30 * MINUTE, "1h": HOUR, "2h": 2 * HOUR, "4h": 4 * HOUR, "6h": 6 * HOUR, "8h": 8 * HOUR, "12h": 12 * HOUR, "1d": DAY, "3d": 3 * DAY, "1w": 7 * DAY, "1M": None}
#: Other spellings, in lower case.
ALIASES = {"60m": "1h", "1hour": "1h", "hour": "1h", "120m": "2h", "240m": "4h", "24h": "1d", "day": "1d", "daily": "1d", "7d": "1w", "week": "1w", "weekly": "1w", "month": "1M", "monthly": "1M", "1mo": "1M", "30d": "1M"}
#: The day the three-day grid moved, and seconds added before division by the step.
GRID_MOVED = 1_692_144_000
SHIFT = {"1w": 3 * DAY, "3d": 2 * DAY}
SHIFT_BEFORE = {"3d": DAY}
#: Shortest length of a bar in seconds; a month has 28 days at least.
LEAST_SECONDS = {k: v or 28 * DAY for k, v in SECONDS.items()}


def exact(name: str) -> str:
    """The interval of exactly that spelling: 1M is a month, 1m a minute."""
    if name not in SECONDS:
        raise ValueError("unknown_interval")
    return name


def parse(name: str) -> str:
    """Exact spelling first, then other spellings in any case."""
    if name in SECONDS:
        return name
    low = name.strip().lower()
    found = ALIASES.get(low) or next((k for k in SECONDS if k != "1M" and k == low), None)
    return exact(found or name)


def from_seconds(seconds: int) -> str | None:
    return next((k for k, v in SECONDS.items() if v == seconds), None)


def folder(name: str) -> str:
    """A folder name that differs from others in more than case."""
    return "1mo" if name == "1M" else name


def seconds_of(at: Column) -> Column:
    """Whole seconds since 1970, towards the past."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / 1_000_000)


def time_of(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def floor(at: Column, name: str) -> Column:
    """Opening time of the bar that holds `at`."""
    step = SECONDS[exact(name)]
    if step is None:
        return F.date_trunc("month", at.cast("timestamp")).cast("timestamp_ntz")
    s, shift = seconds_of(at), F.lit(SHIFT.get(name, 0))
    if name in SHIFT_BEFORE:
        shift = F.when(s >= GRID_MOVED, shift).otherwise(F.lit(SHIFT_BEFORE[name]))
    return time_of(s + shift - F.pmod(s + shift, F.lit(step)) - shift)


def add_bars(at: Column, n: Column, name: str) -> Column:
    """`at` moved by n bars: calendar months (clamped to the month's end) or fixed seconds."""
    step = SECONDS[exact(name)]
    if step is None:
        day = F.add_months(at.cast("date"), n.cast("int"))
        return (day.cast("timestamp_ntz") + (at - F.date_trunc("day", at.cast("timestamp")).cast("timestamp_ntz"))).cast("timestamp_ntz")
    micros = F.unix_micros(at.cast("timestamp")) + n.cast("long") * (step * 1_000_000)
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def ceil(at: Column, name: str) -> Column:
    low = floor(at, name)
    return F.when(low == at, low).otherwise(add_bars(low, F.lit(1), name))


def bars_between(start: Column, end: Column, name: str) -> Column:
    """Whole bars in [start, end); negative if end is before start."""
    step = SECONDS[exact(name)]
    if step is None:
        rough = (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))
        return F.when(add_bars(start, rough, name) > end, rough - 1).otherwise(rough).cast("long")
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000 / step).cast("long")


def is_one_bar(start: Column, end: Column, name: str) -> Column:
    return add_bars(start, F.lit(1), name) == end


def nearest(seconds_per_bar: Column, most_ratio: float = 1.6) -> Column:
    """The interval nearest in ratio; null if all are `most_ratio` times off or more."""
    options = F.array(*[F.struct(F.greatest(seconds_per_bar / s, s / seconds_per_bar).alias("r"), F.lit(k).alias("k")) for k, s in LEAST_SECONDS.items()])
    best = F.array_min(options)
    return F.when(best["r"] < most_ratio, best["k"])


def session_close(calls, sessions, market: Column, submitted: Column, days: Column):
    """Close of the Nth exchange session strictly after the New York date of submission; other markets
    count natural days. sessions: day (date), close (timestamp), one row a day: a few thousand in all, so they
    are ranked in one window; calls meet the one session whose rank they ask for."""
    from pyspark.sql import Window as W

    ordered = W.orderBy("day")
    ranked = sessions.dropDuplicates(["day"]).select("day", "close", F.row_number().over(ordered).alias("_rank"), F.lead("day").over(ordered).alias("_next"))
    # Every date from a session to the next has that session's rank: at most one row a calendar day.
    until = F.coalesce(F.date_sub("_next", 1), F.col("day"))
    dates = ranked.select(F.explode(F.sequence("day", until)).alias("_day"), F.col("_rank").alias("_before"))
    edge = ranked.agg(F.max("day").alias("_last"), F.max("_rank").alias("_most"))
    local = F.from_utc_timestamp(submitted.cast("timestamp"), "America/New_York").cast("date")
    keyed = calls.withColumn("_day", local).withColumn("_n", days)
    met = keyed.join(F.broadcast(dates), "_day", "left").crossJoin(F.broadcast(edge))  # edge is one row
    before = F.coalesce("_before", F.when(F.col("_day") > F.col("_last"), F.col("_most")).otherwise(0))
    asked = met.withColumn("_r", before + F.col("_n"))
    hit = asked.join(F.broadcast(ranked.select(F.col("_rank").alias("_r"), "close")), "_r", "left")
    natural = submitted + F.make_dt_interval(F.col("_n"))
    return hit.withColumn("due", F.when(market == "us_equity", F.col("close")).otherwise(natural.cast("timestamp"))).select(*calls.columns, "due")


def floor_value(at: dt.datetime, name: str) -> dt.datetime:
    """floor() of one Python value, for kernels and tests."""
    step = SECONDS[exact(name)]
    if step is None:
        return at.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    s = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1)
    shift = SHIFT_BEFORE.get(name, SHIFT.get(name, 0)) if s < GRID_MOVED else SHIFT.get(name, 0)
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=(s + shift) // step * step - shift)


#: First letters of month names in time labels.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def time_label(text: Column) -> Column:
    """(year, month, day, hour, minute) of a chart's time label, null where it has none: `MM-DD HH:mm`,
    `MM/DD HH:mm`, `YYYY/MM/DD HH:mm`, `MM-DD`, `HH:mm`, `DD MMM`, `MMM DD`, and labels that lost their month
    (`-04 22:00`) or their minutes (`09-10 05:`). Null for anything else."""
    name = rf"(?<![a-z0-9])({'|'.join(MONTHS)})[^a-z0-9 ,]*(?=[ ,]|$)"
    clock, dated = r"(?<![^ ,])(\d{1,2}):(\d{0,2})(?::\d+)?(?=[ ,]|$)", r"(?<![^ ,])(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?=[ ,]|$)"
    pair, late, lone = r"(?<![^ ,])(\d{1,2})[-/](\d{1,2})(?=[ ,]|$)", r"(?<![^ ,])[-/](\d{1,2})(?=[ ,]|$)", r"(?<![^ ,])(\d{1,2})(?=[ ,]|$)"
    any_part = "|".join((name, clock, dated, pair, late, lone)).replace("(?<![^ ,])", "").replace("(?<![a-z0-9])", "")

    def read(low: Column) -> Column:
        # What does not match is '', which a cast would answer by an exception.
        part = lambda pattern, i: once(F.regexp_extract(low, pattern, i), lambda x: F.when(x != "", x.cast("int")))
        month_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(low, name, 1))
        found = F.struct(
            part(dated, 1).alias("year"),
            F.coalesce(F.nullif(month_name.cast("int"), F.lit(0)), part(dated, 2), part(pair, 1)).alias("month"),
            F.coalesce(part(dated, 3), part(pair, 2), part(late, 1), part(lone, 1)).alias("day"),
            part(clock, 1).alias("hour"),
            F.coalesce(part(clock, 2), F.when(low.rlike(clock), 0)).alias("minute"),
        )
        return F.when(low.rlike(rf"^(?:(?:{any_part}) ?)+$"), found)

    def sound(found: Column) -> Column:
        month, day, hour, minute = (found[c] for c in ("month", "day", "hour", "minute"))
        inside = F.coalesce(month.between(1, 12), F.lit(True)) & F.coalesce(day.between(1, 31), F.lit(True)) & F.coalesce(hour <= 23, F.lit(True)) & F.coalesce(minute <= 59, F.lit(True))
        enough = (day.isNotNull() & (month.isNotNull() | hour.isNotNull())) | hour.isNotNull()
        return F.when(inside & enough, found)

    # Each pattern is matched once a label, however often its parts are named.
    low = F.when(F.length(F.trim(text)).between(1, 24), F.lower(F.regexp_replace(F.trim(text), "[ \u00a0,]+", " ")))
    return once(once(low, read), sound)


def stamp(label: Column, near: Column, offset_minutes: Column) -> Column:
    """Moment of a label with month and day: the year nearest to `near` where it names none; the label's clock is
    `offset_minutes` ahead of UTC."""
    local = near + F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes.cast("int"))
    year = F.coalesce(label["year"], F.year(local))
    at = lambda y: F.try_make_timestamp_ntz(y, label["month"], label["day"], F.coalesce(label["hour"], F.lit(0)), F.coalesce(label["minute"], F.lit(0)), F.lit(0)) - F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes.cast("int"))
    away = lambda x: F.abs(F.unix_micros(x.cast("timestamp")) - F.unix_micros(near.cast("timestamp")))
    option = lambda k: once(at(year + k), lambda x: F.struct(away(x).alias("away"), F.abs(k).alias("k"), x.alias("at")))
    best = F.array_min(F.filter(F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), option), lambda x: x["at"].isNotNull()))
    return F.when(label["year"].isNotNull(), at(year)).otherwise(best["at"])


def utc_offsets(preferred: int | None, local: int) -> list[int]:
    """Offsets in minutes to try: the preferred one, the local one, UTC and +8, each once."""
    return list(dict.fromkeys([local if preferred is None else preferred, local, 0, 480]))
