"""Operator 8: exact top-k inner products by exhaustive term-at-a-time accumulation.

Method: candidates are dealt to blocks by a hash of their id, the stated query set to blocks likewise,
and every pair of blocks is one group. There each dimension has a posting list of (candidate, weight);
a query adds, term by term, weighted postings to a dense array of scores, and a partition selection
keeps its k best of the block. Partial results meet by query. Sizes of blocks bound every group.

Cases: rows without id or vector, or with a null or non-finite component, take no part; vectors of
unequal length count as zero where they have no component (an empty one scores 0 with all); a row never
finds rows of its own id; repeated rows are separate candidates and one query; rows of one id with
different vectors are queries of their own, ranked each; components and scores beyond 64 bits become the
nearest 64-bit number (scores are summed without overflow first); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.llm.common import table
from quillbar.llm.vectors import best, clean, ranked_by_query

CANDIDATES, GROUP_BYTES = 4096, 32 << 20
QUERIES_TOGETHER = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def postings(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (rows, weights) of the components that are not zero."""
    size = np.fromiter(map(len, vectors), np.int64, len(vectors))
    row = np.repeat(np.arange(len(size)), size)
    dim = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    weight = np.concatenate(vectors).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    kept = np.flatnonzero(weight)
    kept = kept[np.argsort(dim[kept], kind="stable")]
    dims, first = np.unique(dim[kept], return_index=True)
    return {int(d): (row[k], weight[k]) for d, k in zip(dims, np.split(kept, first[1:]), strict=True)} if len(dims) else {}


def score_block(ids: np.ndarray, vectors, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    lists = postings(vectors)
    out = [pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}, dtype=np.int64)]
    heaviest = max((float(np.abs(w.astype(np.float64)).max()) for _, w in lists.values()), default=0.0)
    for query, name, terms in zip(queries["vec_id"].tolist(), queries["query"].tolist(), queries["vector"].tolist(), strict=True):
        # Sums that might pass 64 bits are kept as Python's integers.
        exact = heaviest * float(np.abs(np.asarray(terms, np.float64)).sum()) >= 2.0**62
        scores = np.zeros(len(ids), object if exact else np.int64)
        for d in np.flatnonzero(terms):
            if int(d) in lists:
                rows, weights = lists[int(d)]
                scores[rows] += (weights.astype(object) if exact else weights) * int(terms[d])
        if exact:
            scores = np.array([max(LEAST, min(MOST, x)) for x in scores], np.int64)
        other = np.flatnonzero(ids != query)
        top = other[best(scores[other], ids[other], k)]
        out.append(pd.DataFrame({"query_id": query, "query": name, "vec_id": ids[top], "score": scores[top]}))
    return pd.concat(out)


def top_k(rows: DataFrame, is_query, k: int) -> DataFrame:
    """rows: vec_id long, vector array<long>. The k best other rows for each row where is_query."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("w")).first()
    together = max(64, min(CANDIDATES, GROUP_BYTES // (8 * max(1, total["w"]))))
    asking = max(16, min(QUERIES_TOGETHER, GROUP_BYTES // (8 * max(1, total["w"]))))
    blocks, groups = max(1, -(-total["n"] // together)), max(1, -(-total["q"] // asking))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A number that is drawn once deals even many copies of one row evenly to blocks.
    candidates = rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("c"), every(groups).alias("q"))
    name = F.xxhash64("vec_id", "vector")
    asked = rows.where(is_query).select("vec_id", "vector", name.alias("query")).dropDuplicates(["vec_id", "query"])
    asked = asked.withColumn("q", F.pmod("query", F.lit(groups)).cast("int")).withColumn("c", every(blocks))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return score_block(left["vec_id"].to_numpy(np.int64), left["vector"].tolist(), right, k)

    partial = candidates.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInPandas(run, "query_id long, query long, vec_id long, score long")
    return ranked_by_query(partial, k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(column):
    """floor(1024 x) of each component, as the nearest 64-bit number."""
    edge = F.lit(2.0**63)
    scaled = lambda x: F.floor(x * 1024)
    return F.transform(column, lambda x: F.when(x * 1024 >= edge, F.lit(MOST)).when(x * 1024 < -edge, F.lit(LEAST)).otherwise(scaled(x).cast("long")))


def op8(spark, sf_dir: str) -> DataFrame:
    found = clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = found.withColumn("vector", whole_numbers("vector"))
    return top_k(rows, F.col("vec_id") % 100 == 0, 10)


QUERIES = {"op8_exact_top_k": op8}
ORACLES = {
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
}
