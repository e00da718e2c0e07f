"""Operator 7: approximate nearest neighbours by adaptive dimension scans.

Method: vectors are scaled to length 1 and turned by a random rotation, so that any few of their
columns estimate a whole distance. A bounded sample fits the centres of inverted lists; every row is
indexed in the list of its nearest centre. A query probes its nearest lists: as many as hold the share
`TARGET` of true neighbours within the sample, which is many lists where vectors have no clusters, and
further ones until they hold k other rows. Its k-th distance within the sample bounds its k-th distance
overall. In a list, candidates are scanned by column blocks: after each block a hypothesis test compares
the scaled partial distance with that bound and abandons those that are very likely farther. Survivors
are scored exactly, in double precision, on the original vectors. Queries that end with fewer than k rows
are scanned again in all lists without the test, which finds k rows if there are so many.

Lists are dealt to blocks of bounded size by a hash, so a list that a third of all rows share is scanned by
many tasks; the queries of a list are dealt to groups, and a list is read once for each of its groups.

Cases: rows without id or vector, with a null or non-finite component or without length take no part;
vectors of unequal length count as zero where they have no component; a row never finds rows of its own
id; rows that repeat id and vector are one query, and as candidates each of them takes a place; rows of
one id with different vectors are queries of their own, ranked each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.llm.common import bounded_count, materialize, table
from quillbar.llm.vectors import clean, matrix, ranked_by_query

#: Rows and bytes (as double precision) of the sample.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
MOST_LISTS = 1024
BLOCK = 4096
COLUMNS = 16
#: Standard deviations by which a partial distance must exceed its expectation.
EPSILON = 2.4
TARGET = 0.98
QUERIES_TOGETHER = 4096
SEED = 7


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def padded_to(width: int, vectors) -> np.ndarray:
    whole = np.zeros((len(vectors), width))
    given = matrix(vectors)
    whole[:, : given.shape[1]] = given
    return whole


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results wherever they are computed."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def fit_lists(rows: DataFrame, count: int, width: int, k: int, sample: int = SAMPLE, target: float = TARGET) -> dict:
    """Rotation, centres, the turned sample with its ids, and how many lists to probe. The sample has at
    most `sample` rows and SAMPLE_BYTES bytes, chosen by a hash of id and vector."""
    sample = max(k + 2, min(sample, SAMPLE_BYTES // (8 * width)))
    share = min(1.0, 0.9 * sample / max(count, 1))
    few = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1_000_000)) < share * 1_000_000)
    got = few.select("vec_id", "vector").orderBy("vec_id").limit(sample).collect()
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    data, ids = np.zeros((len(got), width)), np.array([r["vec_id"] for r in got], np.int64)
    if got:
        data = unit(padded_to(width, [r["vector"] for r in got])) @ rotation
    lists = int(min(MOST_LISTS, max(1, round(count**0.5 / 2)), max(1, len(data))))
    centres = data[rng.choice(len(data), lists, replace=False)] if len(data) else np.zeros((1, width))
    near = np.zeros(len(data), np.int64)
    for _ in range(8):
        if not len(data):
            break
        near = (data @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, data)
        n = np.bincount(near, minlength=lists)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    probed = len(centres)
    if len(data) > k + 1:
        near = (data @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        asked = rng.choice(len(data), min(256, len(data)), replace=False)
        likeness = data[asked] @ data.T
        likeness[ids[asked][:, None] == ids[None, :]] = -np.inf
        true = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(data[asked] @ centres.T - (centres * centres).sum(1) / 2), axis=1), axis=1)
        probed = int(np.quantile(np.take_along_axis(place, near[true], 1), target)) + 1
    return {"rotation": rotation, "centres": centres, "sample": data.astype(np.float32), "ids": ids, "probed": probed}


def within_sample(model: dict, turned: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Upper bound of each query's k-th squared distance: its k-th one to rows of other ids in the sample."""
    sample = model["sample"]
    if len(sample) < k:
        return np.full(len(turned), np.inf)
    distance = 2 - 2 * (turned.astype(np.float32) @ sample.T)
    distance[own[:, None] == model["ids"][None, :]] = np.inf
    return np.partition(distance, k - 1, axis=1)[:, k - 1] + 1e-4


def scan(turned: np.ndarray, queries: np.ndarray, most: np.ndarray, epsilon: float = EPSILON, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) that the adaptive scan could not rule out. most: bound of each query's distance."""
    width, dense = turned.shape[1], True
    row = query = distance = None
    for at in range(0, width, columns):
        x, q = turned[:, at : at + columns], queries[:, at : at + columns]
        seen = min(at + columns, width)
        slack = 1.0 if seen == width else (1 + epsilon / np.sqrt(seen)) ** 2 * seen / width
        if dense:  # while many are alive, a block is one matrix product
            step = (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (x @ q.T)
            distance = step if distance is None else distance + step
            alive = distance <= (most * slack)[None, :]
            if seen == width or alive.mean() < 0.1:
                row, query = np.nonzero(alive)
                distance, dense = distance[row, query], False
        else:
            step = x[row] - q[query]
            distance = distance + (step * step).sum(1)
            alive = distance <= most[query] * slack
            row, query, distance = row[alive], query[alive], distance[alive]
    return row, query


def search(rows: DataFrame, is_query, k: int) -> DataFrame:
    """rows: vec_id, vector. The k nearest other rows found for each row where is_query."""
    # Copies would take the places of other neighbours within a block: they are counted here, and expanded at the end.
    found = rows.groupBy("vec_id", "vector").agg(F.max(is_query).alias("is_query"), F.count(F.lit(1)).alias("copies"))
    rows = materialize(found.withColumn("query", F.xxhash64("vec_id", "vector")), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("w")).first()
    width = max(1, size["w"])
    fitted = fit_lists(rows, size["n"], width, k)
    # width x width, at most MOST_LISTS x width and at most SAMPLE x width numbers
    model = rows.sparkSession.sparkContext.broadcast(fitted)

    def turn(vectors) -> np.ndarray:
        return unit(padded_to(width, vectors)) @ model.value["rotation"]

    def index(batches):
        centre = model.value["centres"]
        for pdf in batches:
            if len(pdf):
                turned = turn(pdf["vector"].tolist())
                pdf["list"] = (turned @ centre.T - (centre * centre).sum(1) / 2).argmax(1).astype(np.int32)
                pdf["turned"] = list(turned.astype(np.float32))
                yield pdf

    schema = "vec_id long, vector array<double>, copies long, list int, turned array<float>"
    indexed = materialize(rows.select("vec_id", "vector", "copies").mapInPandas(index, schema), "lists")
    held = np.zeros(len(fitted["centres"]), np.int64)
    for row in indexed.groupBy("list").count().collect():  # one row a list, MOST_LISTS at most
        held[row["list"]] = row["count"]

    def probe(batches):
        centre = model.value["centres"]
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                some = pdf.iloc[lo : lo + 256].copy()
                turned = turn(some["vector"].tolist())
                some["most"] = within_sample(model.value, turned, some["vec_id"].to_numpy(), k).astype(np.float64)
                order = np.argsort(-(turned @ centre.T - (centre * centre).sum(1) / 2), axis=1, kind="stable")
                enough = [int(np.searchsorted(np.cumsum(held[x]), min(k + 1, held.sum()))) + 1 for x in order]
                some["lists"] = [x[: max(model.value["probed"], n)].astype(np.int32) for x, n in zip(order, enough, strict=True)]
                yield some

    asked = rows.where("is_query").select("vec_id", "vector", "query").mapInPandas(probe, "vec_id long, vector array<double>, query long, most double, lists array<int>")
    asked = materialize(asked, "queries")
    best = materialize(scanned(indexed, asked, held, width, turn, k, EPSILON), "nearest")
    full = best.groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "query")
    short = materialize(asked.join(full, ["vec_id", "query"], "left_anti").withColumn("lists", F.array(*[F.lit(int(x)) for x in np.flatnonzero(held)]).cast("array<int>")), "queries")
    if bounded_count(short):
        again = scanned(indexed, short, held, width, turn, k, np.inf)
        best = best.join(short.select(F.col("vec_id").alias("query_id"), "query"), ["query_id", "query"], "left_anti").unionByName(again)
    return best.select("query_id", "rank", "vec_id", "score")


def scanned(indexed: DataFrame, asked: DataFrame, held: np.ndarray, width: int, turn, k: int, epsilon: float) -> DataFrame:
    """query_id, query, rank, vec_id, score: the k best rows of the lists that each query asks for."""
    queries = np.zeros(len(held), np.int64)
    for row in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # one row a list
        queries[row["list"]] = row["count"]
    per_list = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("list") + 1)
    parts, groups = per_list(np.maximum(1, -(-held // BLOCK))), per_list(-(-queries // QUERIES_TOGETHER))
    upto = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    left = indexed.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), parts).cast("int")).where(groups > 0).withColumn("q", upto(groups))
    right = asked.withColumn("list", F.explode("lists")).drop("lists").withColumn("q", F.pmod(F.col("query"), groups).cast("int")).withColumn("part", upto(parts))
    kinds = "query_id long, query long, vec_id long, copies long, score double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "copies": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(left) and len(right):
            ids, copies, turned = left["vec_id"].to_numpy(np.int64), left["copies"].to_numpy(np.int64), np.stack(left["turned"].to_list())
            own = padded_to(width, left["vector"].tolist())
            for lo in range(0, len(right), 512):
                some = right.iloc[lo : lo + 512]
                asking, name, given = some["vec_id"].to_numpy(np.int64), some["query"].to_numpy(np.int64), padded_to(width, some["vector"].tolist())
                row, q = scan(turned, turn(some["vector"].tolist()).astype(np.float32), some["most"].to_numpy(), epsilon)
                other = ids[row] != asking[q]
                row, q = row[other], q[other]
                score = cosine(own[row], given[q])
                order = np.lexsort((ids[row], -score, q))
                row, q, score = row[order], q[order], score[order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                row, q, score = row[place < k], q[place < k], score[place < k]
                out.append(pd.DataFrame({"query_id": asking[q], "query": name[q], "vec_id": ids[row], "copies": copies[row], "score": score}))
        return pd.concat(out)

    partial = left.groupBy("list", "part", "q").cogroup(right.groupBy("list", "part", "q")).applyInPandas(run, kinds)
    ranked = ranked_by_query(partial, k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    return ranked_by_query(ranked.drop("rank", "copies", "copy"), k)


def with_length(rows: DataFrame) -> DataFrame:
    """The rows whose vector is not zero."""
    return rows.where(F.exists("vector", lambda x: x != 0))


def op7(spark, sf_dir: str) -> DataFrame:
    rows = with_length(clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search(rows, F.col("vec_id") % 50 == 0, 5)


QUERIES = {"op7_nearest_neighbours": op7}
ORACLES: dict[str, str] = {}
