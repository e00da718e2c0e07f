"""Values that an expression names several times and works out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is worked out once a row, however often and under whatever conditions it is named."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))
