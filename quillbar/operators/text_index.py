"""An inverted index of the 1-, 2- and 3-character grams of a text column, for literal search in any case.

A posting row holds the keys of one gram within one batch of texts as differences; rows are sorted by gram within buckets, so a search reads
the buckets and row groups of its own grams. The rarest grams of a phrase are intersected; what is left is verified literally on the texts. Phrases
of one or two characters are grams themselves. Later texts are appended as files of their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbar.functions.text import contains_literal

BUCKETS = 64
#: Grams of a phrase that are intersected, and characters that a task indexes together.
RAREST, TOGETHER = 4, 4_000_000
#: Candidates that are looked up by a filter on the key, which reaches the files; more are joined.
LOOKED_UP = 1000


def grams(text: str) -> set[str]:
    """All runs of one to three characters."""
    pairs = {a + b for a, b in zip(text, text[1:], strict=False)}
    return set(text) | pairs | {a + b + c for a, b, c in zip(text, text[1:], text[2:], strict=False)}


def wanted(phrase: str) -> list[str]:
    """The longest grams of a phrase."""
    return [phrase] if len(phrase) < 3 else sorted({phrase[i : i + 3] for i in range(len(phrase) - 2)})


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys: the width of a difference, the first key, the differences."""
    step = np.diff(keys).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if not len(step) or int(step.max()) < 1 << 8 * w)
    return bytes([width]) + keys[:1].astype("<i8").tobytes() + step.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.int64)
    return np.frombuffer(data, "<i8", 1, 1)[0] + np.concatenate([[0], np.cumsum(step)])


def _postings(batches) -> Iterator[pd.DataFrame]:
    found, held = defaultdict(list), 0

    def flush() -> pd.DataFrame:
        rows = [(g, len(k), int(min(k)), packed(np.unique(np.array(k, np.int64)))) for g, k in found.items()]
        return pd.DataFrame(rows, columns=["gram", "n", "first", "keys"])

    for pdf in batches:
        for key, text in zip(pdf["key"].tolist(), pdf["text"].tolist(), strict=True):
            for g in grams(text):
                found[g].append(key)
            held += len(text)
            if held > TOGETHER:
                yield flush()
                found, held = defaultdict(list), 0
    if found:
        yield flush()


def _bucket():
    return F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")


def add(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Appends the texts of rows to the index below path. Null keys and texts are not indexed."""
    low = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.lower(F.col(f"`{text}`")).alias("text")).where("key is not null and text is not null")
    found = low.mapInPandas(_postings, "gram string, n long, first long, keys binary").withColumn("bucket", _bucket())
    # A range of grams and keys is a task's: a gram of very many texts is several tasks'.
    dealt = found.repartitionByRange("bucket", "gram", "first").sortWithinPartitions("bucket", "gram", "first")
    dealt.write.partitionBy("bucket").mode("append").parquet(f"{path}/grams")


def postings(spark: SparkSession, path: str, some: list[str]) -> DataFrame:
    """Rows of these grams: their buckets are the only folders that are read."""
    found = spark.read.schema("gram string, n long, first long, keys binary, bucket int").parquet(f"{path}/grams")
    buckets = spark.createDataFrame([(g,) for g in some], "gram string").select(_bucket().alias("b")).distinct().collect()  # BUCKETS at most
    return found.where(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("gram").isin(some))


def candidates(spark: SparkSession, path: str, phrase: str) -> DataFrame | None:
    """key of the texts that hold the rarest grams of a lower-cased phrase; None if some gram has no text."""
    some = wanted(phrase)
    counts = {r["gram"]: r["n"] for r in postings(spark, path, some).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the phrase
    if len(counts) < len(some):
        return None
    rarest = sorted(some, key=lambda g: (counts[g], g))[:RAREST]

    def keys(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for gram, data in zip(pdf["gram"].tolist(), pdf["keys"].tolist(), strict=True):
                yield pd.DataFrame({"gram": gram, "key": unpacked(data)})

    found = postings(spark, path, rarest).select("gram", "keys").mapInPandas(keys, "gram string, key long")
    return found.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("key")


def search(rows: DataFrame, path: str, phrase: str, key: str, text: str) -> DataFrame:
    """The rows whose text holds the phrase, in any case: those that a scan with contains_literal finds. rows: the indexed table."""
    spark = rows.sparkSession
    low = spark.range(1).select(F.lower(F.lit(phrase)).alias("p")).first()["p"]
    hit = contains_literal(F.col(f"`{text}`"), F.lit(phrase))
    if not low:
        return rows.where(hit)
    found = candidates(spark, path, low)
    if found is None:
        return rows.where(F.lit(False))
    few = [r["key"] for r in found.limit(LOOKED_UP + 1).collect()]
    if len(few) <= LOOKED_UP:
        return rows.where(F.col(f"`{key}`").isin(few) & hit)
    return rows.join(found.withColumnRenamed("key", "_key"), F.col(f"`{key}`") == F.col("_key"), "left_semi").where(hit)


def search_all(rows: DataFrame, path: str, phrases: list[str], key: str, text: str) -> DataFrame:
    """phrase and the columns of rows: for each phrase the rows that search() finds. The grams of all phrases are read together, and every text that
    some phrase may be in is met once, whatever the number of phrases."""
    spark = rows.sparkSession
    named = spark.createDataFrame(list(enumerate(phrases)), "i int, p string")
    low = {r["i"]: r["p"] for r in named.select("i", F.lower("p").alias("p")).collect()}
    some = sorted({g for p in low.values() for g in wanted(p)} - {""})
    counts = {r["gram"]: r["n"] for r in postings(spark, path, some).groupBy("gram").agg(F.sum("n").alias("n")).collect()} if some else {}  # a row a gram of the phrases
    rarest = {i: sorted(wanted(p), key=lambda g: (counts[g], g))[:RAREST] for i, p in low.items() if p and all(g in counts for g in wanted(p))}
    asked: dict[str, list[tuple[int, int]]] = defaultdict(list)  # gram -> phrases, and the bit it has in each
    for i, chosen in rarest.items():
        for bit, g in enumerate(chosen):
            asked[g].append((i, 1 << bit))

    def keys(batches) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for gram, data in zip(pdf["gram"].tolist(), pdf["keys"].tolist(), strict=True):
                found = unpacked(data)
                for i, bit in asked[gram]:
                    yield pd.DataFrame({"i": np.full(len(found), i, np.int32), "bit": np.full(len(found), bit, np.int32), "_key": found})

    parts = []
    if asked:
        met = postings(spark, path, sorted(asked)).select("gram", "keys").mapInPandas(keys, "i int, bit int, _key long").repartition("_key")
        whole = F.element_at(F.create_map(*[F.lit(x) for i, chosen in rarest.items() for x in (i, (1 << len(chosen)) - 1)]), F.col("i"))
        may = met.groupBy("_key", "i").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == whole).groupBy("_key").agg(F.collect_list("i").alias("_may"))
        both = rows.join(may, F.col(f"`{key}`") == F.col("_key"))
        own = F.element_at(F.array(*[F.lit(p) for p in phrases]), F.col("_i") + 1)
        parts.append(both.withColumn("_i", F.explode("_may")).withColumn("phrase", own).where(contains_literal(F.col(f"`{text}`"), F.col("phrase"))))
    parts += [rows.withColumn("phrase", F.lit(phrases[i])).where(contains_literal(F.col(f"`{text}`"), F.lit(phrases[i]))) for i, p in low.items() if not p]
    columns = ["phrase", *[f"`{c}`" for c in rows.columns]]
    if not parts:
        return rows.withColumn("phrase", F.lit("")).where(F.lit(False)).select(*columns)
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
