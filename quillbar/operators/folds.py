"""Sequential folds over sorted partitions, and dense numbering of whole tables.

A fold reads the rows of a key in order as they stream by, batch after batch, and keeps a small state; a key
with very many rows costs time but no memory. Keys are dealt to partitions by a hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.session import written


#: Rows of lists that are passed on together.
TOGETHER = 10_000


def folded(df: DataFrame, keys: list[str], order: list[str], begin: Callable, schema: str, frame: Callable | None = None) -> DataFrame:
    """begin(key) gives an object whose push(rows) and done() return the next rows of the result, or None.
    Rows come in `order` within their key; a null is a key like others. With `frame`, they return lists of rows, of
    which those of many keys become one frame."""

    def run(batches):
        if frame is None:
            yield from each(batches)
            return
        held = []
        for out in each(batches):
            held += out
            if len(held) >= TOGETHER:
                yield frame(held)
                held = []
        if held:
            yield frame(held)

    def each(batches):
        now, fold = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            parts = pdf[keys]
            same = np.ones(len(pdf), bool)
            for k in keys:
                column = parts[k]
                same &= ((column == column.shift()) | (column.isna() & column.shift().isna())).fillna(False).to_numpy(bool)
            edges = np.flatnonzero(~same)
            edges = edges if len(edges) and edges[0] == 0 else np.concatenate([[0], edges])
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(pdf)], strict=True):
                key = tuple(None if pd.isna(x) else x for x in parts.iloc[lo])
                if fold is None or key != now:
                    if fold is not None and (rest := fold.done()) is not None:
                        yield rest
                    now, fold = key, begin(key)
                if (out := fold.push(pdf.iloc[lo:hi])) is not None:
                    yield out
        if fold is not None and (rest := fold.done()) is not None:
            yield rest

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with numbers from 1 in the given order, which must tell rows apart. Ranges are sorted apart, written,
    and shifted by the sizes of those before them; no task orders everything."""
    placed = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    number = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, number).drop("_part", "_id", "_before")
