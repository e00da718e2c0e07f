"""What the two vector searches share: clean rows, and the merge of partial results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id (long), vector (array<double>) of the rows that take part: key and vector not null, no
    null, NaN or infinite component. Other columns are dropped."""
    found = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return found.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)


def ranked_by_query(partial: DataFrame, k: int) -> DataFrame:
    """partial (query_id, query, vec_id, score, ...) with rank: the k best rows of each query, equal scores by
    smaller vec_id. `query` tells apart queries that share an id."""
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, equal scores by smaller id, in that order."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        kept = np.flatnonzero(score >= least)
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], -score[kept]))][:k]


def matrix(vectors, dtype=np.float64) -> np.ndarray:
    """Rows of equal length: shorter vectors are padded with zeros."""
    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = np.zeros((len(size), int(size.max(initial=0))), dtype)
    if len(size):
        out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(vectors) if size.sum() else []
    return out
