"""Exact decimals as text: bounded parsing, 34-digit half-even arithmetic, fixed output scale."""

from __future__ import annotations

import decimal
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbar.functions.binding import once

CONTEXT = decimal.Context(prec=34, rounding=decimal.ROUND_HALF_EVEN, Emin=-6000, Emax=6000)
_WIDE = decimal.Context(prec=400, rounding=decimal.ROUND_HALF_EVEN)


def dec(text: str | None) -> Decimal:
    """A decimal of at most 96 characters and 64 places; ValueError otherwise."""
    if text is None or len(text) > 96:
        raise ValueError("invalid_decimal")
    try:
        value = Decimal(text)
    except decimal.InvalidOperation:
        raise ValueError("invalid_decimal") from None
    if not value.is_finite() or abs(value.as_tuple().exponent) > 64:
        raise ValueError("invalid_decimal")
    return value


def q(value: Decimal) -> Decimal:
    return CONTEXT.plus(value)


def times(a: Decimal, b: Decimal) -> Decimal:
    return CONTEXT.multiply(a, b)


def ratio(a: Decimal, b: Decimal) -> Decimal:
    return CONTEXT.divide(a, b)


def fmt(value: Decimal) -> str:
    """Scale 12, half-even, without trailing zeros."""
    return plain(value.quantize(Decimal("1E-12"), decimal.ROUND_HALF_EVEN, _WIDE))


def plain(value: Decimal) -> str:
    """Without exponent and trailing zeros."""
    if not value:
        return "0"
    return format(value.normalize(_WIDE), "f")


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """Plain text of a valid decimal, null of any other."""

    def one(x):
        try:
            return plain(dec(x))
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


def is_valid(text: Column) -> Column:
    """Whether dec() takes it: plain or exponent notation, 96 characters, 64 places."""
    return F.coalesce((F.length(text) <= 96) & normalized(text).isNotNull(), F.lit(False))


def rounded_12(value: Column) -> Column:
    return F.bround(value, 12)


def trimmed(text: Column) -> Column:
    """Decimal text without trailing zeros, and without a point that ends it."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def printed_tolerance(text: Column) -> Column:
    """A printed number is known to about one unit of its last place."""
    places = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    return F.pow(F.lit(10.0), -places) * 1.01


def label_number(text: Column) -> Column:
    """Numbers of chart labels: dashes, thousands separators and K, M, B."""
    clean = F.regexp_replace(F.translate(text, "−–—", "---"), ",", "")
    value = F.regexp_extract(clean, r"^\s*([+-]?\d+(?:\.\d+)?)\s*([KMBkmb]?)\s*$", 1)
    unit = F.upper(F.regexp_extract(clean, r"^\s*([+-]?\d+(?:\.\d+)?)\s*([KMBkmb]?)\s*$", 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(value != "", value.cast("double") * scale)


#: Text of a signed plain decimal, as the exact operations below take it; others give null.
_PLAIN = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*\z"


#: Numbers that Spark's decimals hold exactly, those from one on among them, and whole ones; the general forms are for the rest.
_SHORT, _FROM_ONE, _WHOLE = r"^-?\d{1,18}(?:\.\d{1,6})?\z", r"^-?[1-9]\d{0,17}(?:\.\d{1,6})?\z", r"^-?[1-9]\d{0,17}\z"


def _number(text: Column) -> Column:
    return text.try_cast("decimal(24,6)")


def _moved(number: Column, places: int) -> Column:
    return (number * F.lit(Decimal(10).scaleb(places - 1))).cast(f"decimal(38,{max(0, 6 - places)})")


def _shown(number: Column, scale: int) -> Column:
    """Text of a decimal of this scale, which is six at most or of a number that is not small."""
    text = number.cast("string")
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if scale > 0 else text


def _parts(text: Column) -> Column:
    """negative, whole and fraction of plain decimal text, null of any other."""

    def split(text: Column) -> Column:
        fraction = lambda bare: F.when(bare.contains("."), F.substring_index(bare, ".", -1)).otherwise("")
        found = once(F.translate(text, "+- \t\n\x0b\f\r", ""), lambda bare: F.struct(text.contains("-").alias("negative"), F.substring_index(bare, ".", 1).alias("whole"), fraction(bare).alias("fraction")))
        return F.when(text.rlike(_PLAIN), found)

    return once(text, split)


def _joined(negative: Column, whole: Column, fraction: Column) -> Column:
    def body(x: Column) -> Column:
        whole, fraction = x["whole"], x["fraction"]
        sign = F.when(negative & ((whole != "") | (fraction != "")), "-").otherwise("")
        return F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))

    return once(F.struct(F.ltrim(whole, F.lit("0")).alias("whole"), F.rtrim(fraction, F.lit("0")).alias("fraction")), body)


def shifted(text: Column, places: int) -> Column:
    """The point moved `places` to the right (left, if negative), on digits: exact at any length."""
    n = abs(places)

    def moved(x: Column) -> Column:
        whole, fraction = x["whole"], x["fraction"]
        if places >= 0:
            whole, fraction = F.concat(whole, F.rpad(fraction, n, "0")), F.substring(fraction, F.lit(n + 1), F.length(fraction))
        else:
            long = F.lpad(whole, F.greatest(F.length(whole), F.lit(n)), F.lit("0"))
            cut = F.length(long) - n
            whole, fraction = F.substring(long, F.lit(1), cut), F.concat(F.substring(long, cut + 1, F.lit(n)), fraction)
        return F.when(x.isNotNull(), _joined(x["negative"], whole, fraction))

    general = once(_parts(text), moved)
    if n > 6:
        return general
    return F.when(text.rlike(_SHORT if places >= 0 else _FROM_ONE), _shown(_moved(_number(text), places), max(0, 6 - places))).otherwise(general)


def _next(digits: Column) -> Column:
    """The digits of the next whole number."""
    kept = F.rtrim(digits, F.lit("9"))
    last = (F.substring(kept, -1, 1).cast("int") + 1).cast("string")
    more = F.when(kept == "", "1").otherwise(F.concat(F.substring(kept, F.lit(1), F.length(kept) - 1), last))
    return F.concat(more, F.repeat(F.lit("0"), F.length(digits) - F.length(kept)))


def rounded(text: Column, places: int) -> Column:
    """Rounded half up to `places`, on digits: exact at any length."""
    if places < 0:
        return shifted(rounded(shifted(text, places), 0), -places)

    def cut(x: Column) -> Column:
        up = F.substring(x["fraction"], places + 1, 1) >= "5"
        digits = once(F.concat(x["whole"], F.rpad(x["fraction"], places, "0")), lambda d: F.when(up, _next(d)).otherwise(d))
        whole = lambda d: F.substring(d, F.lit(1), F.length(d) - places)
        fraction = lambda d: F.substring(d, F.length(d) - places + 1, F.lit(places))
        return F.when(x.isNotNull(), once(digits, lambda d: _joined(x["negative"], whole(d), fraction(d))))

    general = once(_parts(text), cut)
    return F.when(text.rlike(_SHORT), _shown(F.round(_number(text), places), places)).otherwise(general) if places <= 6 else general


def grouped(text: Column) -> Column:
    """Thousands separators in the whole part; the fraction is left alone."""

    def shown(x: Column) -> Column:
        body = F.reverse(F.regexp_replace(F.reverse(F.when(x["whole"] == "", "0").otherwise(x["whole"])), r"(\d{3})(?=\d)", "$1,"))
        tail = F.when(x["fraction"] != "", F.concat(F.lit("."), x["fraction"])).otherwise("")
        return F.when(x.isNotNull(), F.concat(F.when(x["negative"], "-").otherwise(""), body, tail)).otherwise(text)

    return F.when(text.rlike(_WHOLE), F.format_number(text.try_cast("long"), 0)).otherwise(once(_parts(text), shown))


def percent(text: Column, places: int = 2) -> Column:
    """A ratio as a signed percentage: the point moved, never multiplied."""
    sign = lambda v: F.when(v.startswith("-") | (v == "0"), "").otherwise("+")
    general = once(once(shifted(text, 2), lambda v: rounded(v, places)), lambda v: F.concat(sign(v), v, F.lit("%")))
    if not 0 <= places <= 6:
        return general
    short = F.round(_moved(_number(text), 2), places)
    return F.when(text.rlike(_SHORT), F.concat(F.when(short > 0, "+").otherwise(""), _shown(short, min(places, 4)), F.lit("%"))).otherwise(general)
