"""Hybrid retrieval: lexical and dense candidates, rank fusion, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.functions.text import contains_literal, search_phrase
from quillbar.operators.relational import first_by


def lexical(chunks: DataFrame, phrase: str, limit: int = 60) -> DataFrame:
    """Chunks with the phrase, newest first. chunks: chunk_id, document_id, occurred_at, text."""
    hits = chunks.where(contains_literal(F.col("text"), F.lit(phrase)))
    return hits.orderBy(F.desc("occurred_at"), "chunk_id").limit(limit)


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Ranks from 0 of a bounded list of hits."""
    return df.withColumn("rank0", F.row_number().over(W.orderBy(*order)) - 1)


def fused(lists: list[DataFrame], key: str, document: str, limit: int) -> DataFrame:
    """Reciprocal rank fusion, sum of 1 / (61 + rank): ties by id, best chunk of each document. Each list
    has key, document and rank0."""
    every = lists[0].select(key, document, "rank0")
    for other in lists[1:]:
        every = every.unionByName(other.select(key, document, "rank0"))
    score = every.groupBy(key, document).agg(F.sum(1.0 / (F.col("rank0") + 61)).alias("score"))
    return first_by(score, [document], [F.desc("score"), key]).orderBy(F.desc("score"), key).limit(limit)


def image_and_text(images: DataFrame, texts: DataFrame, key: str, missing: int = 120) -> DataFrame:
    """1 / (61 + image rank) + 1 / (60 + text rank); a missing text rank counts as 120."""
    both = images.select(key, F.col("rank0").alias("image_rank")).join(texts.select(key, F.col("rank").alias("text_rank")), key, "left")
    return both.withColumn("score", 1.0 / (61 + F.col("image_rank")) + 1.0 / (60 + F.coalesce("text_rank", F.lit(missing))))


def dense(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int = 60, kinds: tuple[str, ...] = (), before: Column | None = None, dirty: DataFrame | None = None) -> DataFrame:
    """Chunks nearest to a query vector by cosine, with rank0; those of documents whose index is out of date do
    not count. chunks: chunk_id, document_id, occurred_at and, if kinds are given, kind; vectors: chunk_id,
    embedding; dirty: document_id."""
    from quillbar.operators.shapes import nearest

    able = chunks.where(F.col("kind").isin(*kinds)) if kinds else chunks
    able = able if before is None else able.where(F.col("occurred_at") < before)
    able = able if dirty is None else able.join(dirty.select("document_id"), "document_id", "left_anti")
    found = nearest(able.join(vectors, "chunk_id").withColumn("id", F.col("chunk_id")), query, limit)
    return ranked(found.drop("id"), ["distance", "chunk_id"])


def model_pair(geometry: DataFrame, visual: DataFrame, limit: int, most: int = 50) -> DataFrame:
    """Fusion of two models' lists of `most` hits (call_id, group_id, rank0): sums of 1 / (61 + rank), the best call
    of each group, ties by call_id."""
    lists = [x.where(F.col("rank0") < most) for x in (geometry, visual)]
    return fused([x.select("call_id", "group_id", "rank0") for x in lists], "call_id", "group_id", limit)


def in_order_of(hits: DataFrame, wanted: list, column: str) -> DataFrame:
    """Hits sorted as their values stand in a list; others last."""
    place = F.array_position(F.array(*[F.lit(x) for x in wanted]), F.col(column))
    return hits.orderBy(F.when(place == 0, len(wanted) + 1).otherwise(place), column)


def index_status(sources: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: documents pending, the oldest of them, and documents indexed. sources: document_id,
    version, occurred_at; indexed: document_id, version."""
    old = indexed.select("document_id", F.col("version").alias("_v"))
    both = sources.join(old, "document_id", "left")
    dirty = ~F.col("version").eqNullSafe(F.col("_v"))
    return both.agg(F.count_if(dirty).alias("pending"), F.min(F.when(dirty, F.col("occurred_at"))).alias("oldest"), F.count_if(~dirty).alias("indexed"))


def to_repair(sources: DataFrame, indexed: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents of another version than indexed, or without vector. The three tables are dealt by document once, each task sorts its
    part of them, and rows of a document are summed up as they pass: nothing of a task grows but what Spark spills."""
    kind = sources.schema["document_id"].dataType
    side = lambda df, name, version: df.select(F.col("document_id").cast(kind).alias("document_id"), version.alias("version"), F.lit(name).alias("_of"))
    none = F.lit(None).cast(sources.schema["version"].dataType)
    every = side(sources, 0, F.col("version")).unionByName(side(indexed, 1, F.col("version"))).unionByName(side(vectors, 2, none)).where("document_id is not null or _of = 0")
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(tasks, "document_id").sortWithinPartitions("document_id", "version")
    has = lambda name: F.max(F.col("_of") == name)
    # A null version equals no version, as in a join.
    same = dealt.groupBy("document_id", "version").agg(has(0).alias("known"), (has(1) & F.col("version").isNotNull()).alias("indexed"), has(2).alias("vector"))
    found = same.groupBy("document_id").agg(F.max("known").alias("known"), F.max(F.col("known") & ~F.col("indexed")).alias("stale"), F.max("vector").alias("vector"))
    return found.where(F.col("known") & (F.col("stale") | ~F.col("vector"))).select("document_id")


def source_by_version(sources: DataFrame, document_id, version) -> DataFrame:
    """The source; a job that meets another version fails."""
    found = sources.where(F.col("document_id") == document_id)
    return found.where(F.when(F.col("version") == version, True).otherwise(F.raise_error(F.lit("version_mismatch")).cast("boolean")))


def catalogue(instruments: DataFrame, phrase: str, popular: str = "popularity") -> DataFrame:
    """Instruments whose symbol or base holds the phrase: exact, prefix, then anywhere; active and popular
    ones first. instruments: symbol, base, active, popularity."""
    p = search_phrase(F.lit(phrase))
    rank = F.when(F.col("symbol") == p, 0).when(F.col("base") == p, 1).when(F.startswith("symbol", p), 2).when(F.contains("symbol", p), 3)
    found = instruments.withColumn("search_rank", rank).where("search_rank is not null").withColumn("inactive", (~F.col("active")).cast("int"))
    return found.orderBy("search_rank", "inactive", F.asc_nulls_last(popular), "symbol")


def after_rank(hits: DataFrame, symbol: str) -> DataFrame:
    """Hits after the one of a symbol, by (search_rank, inactive, popularity, symbol); unknown popularity last."""
    place = F.struct("search_rank", "inactive", F.col("popularity").isNull().alias("unknown"), F.coalesce("popularity", F.lit(0)).alias("popularity"), "symbol")
    cursor = hits.where(F.col("symbol") == symbol).select(place.alias("_c")).limit(1)
    return hits.crossJoin(F.broadcast(cursor)).where(place > F.col("_c")).drop("_c")  # the cursor is one row


def tagged(records: DataFrame, tags: DataFrame, wanted: str) -> DataFrame:
    """Records with a tag of that name or alias. tags: record_id, name, aliases."""
    hit = tags.where((F.col("name") == wanted) | F.array_contains("aliases", wanted))
    return records.join(hit.select("record_id"), "record_id", "left_semi")


def latest_tags(tags: DataFrame) -> DataFrame:
    return first_by(tags, ["name"], [F.desc("version"), F.desc("created_at")])


def preview(text: Column, size: int = 500) -> Column:
    return F.left(text, F.lit(size))
