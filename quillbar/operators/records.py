"""Record views: nested details, source mapping, versions, private search, plan clipping and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbar.operators.relational import first_by


def detail(records: DataFrame, parts: dict[str, tuple[DataFrame, list[str], list[str]]], key: str) -> DataFrame:
    """records with one ordered array of structs for each part: name -> (rows, fields, order). Each part
    is grouped by the key before it is joined, so parts never multiply."""
    out = records
    for name, (rows, fields, order) in parts.items():
        items = F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v")))), lambda x: x["v"])
        grouped = rows.groupBy(key).agg(items.alias(name))
        out = out.join(grouped, key, "left")
    return out


def mapped_sources(hits: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """record_id of each hit (kind, source_id) by its kind; sources: kind -> (source_id, record_id)."""
    every = None
    for kind, rows in sources.items():
        part = rows.select(F.lit(kind).alias("kind"), "source_id", "record_id")
        every = part if every is None else every.unionByName(part)
    return hits.join(every, ["kind", "source_id"])


def current_scenes(scenes: DataFrame) -> DataFrame:
    """The latest scene of each record, and whether it came after submission. scenes: record_id,
    scene_id, created_at, submitted_at."""
    latest = first_by(scenes, ["record_id"], [F.desc("created_at"), F.desc("scene_id")])
    return latest.withColumn("after_submission", F.col("created_at") > F.col("submitted_at"))


def next_versions(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """name and version that each wanted tag gets: one above its greatest."""
    last = tags.groupBy("name").agg(F.max("version").alias("_v"))
    return wanted.join(last, "name", "left").select("name", (F.coalesce("_v", F.lit(0)) + 1).alias("version"))


def private_hits(scored: DataFrame, evidence: DataFrame, limit: int) -> DataFrame:
    """Private image search: hits whose image is evidence that predates its call, one a file, then one a
    confirmed episode. scored: call_id, file_hash, episode_id, confirmed, submitted_at, distance;
    evidence: call_id, recorded_at."""
    gate = scored.join(evidence, "call_id").where(F.col("recorded_at") <= F.col("submitted_at")).drop("recorded_at")
    by_file = first_by(gate, ["file_hash"], ["distance", "call_id"])
    group = F.when(F.col("confirmed"), F.concat(F.lit("e"), "episode_id")).otherwise(F.concat(F.lit("c"), "call_id"))
    one = first_by(by_file.withColumn("_g", group), ["_g"], ["distance", "call_id"]).drop("_g")
    return one.orderBy("distance", "call_id").limit(max(1, min(50, limit)))


def clipped_scopes(scopes: DataFrame, lifecycle: DataFrame, key: str = "symbol") -> DataFrame:
    """Plan scopes (key, start, end) within each instrument's listing; what is empty then goes.
    lifecycle: key, listed, delisted (null: still listed)."""
    joined = scopes.join(lifecycle, key)
    clipped = joined.select(key, F.greatest("start", "listed").alias("start"), F.when(F.col("delisted").isNull(), F.col("end")).otherwise(F.least("end", "delisted")).alias("end"))
    return clipped.where("start < end")


def advanced_cursors(stored: DataFrame, done: DataFrame, keys: list[str], step_seconds: Column, window: int, stride: int) -> DataFrame:
    """Where the next incremental build starts: the end of what is done less a window's overlap, never
    before the stored cursor. stored: keys, cursor; done: keys, end (seconds)."""
    back = F.max(F.col("end") - (window - stride) * step_seconds).alias("_new")
    fresh = done.groupBy(*keys).agg(back)
    both = stored.join(fresh, keys, "full_outer")
    return both.select(*keys, F.greatest("cursor", "_new").alias("cursor"))


def source_proofs(features: DataFrame, proofs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features with their latest proof, one row with how many had none)."""
    latest = first_by(proofs, ["feature_id"], [F.desc("created_at"), F.desc("generation_id")])
    kept = features.join(latest.select("feature_id", "generation_id"), "feature_id", "left")
    return kept.where("generation_id is not null"), kept.agg(F.count_if(F.col("generation_id").isNull()).alias("dropped"))


def keyset_events(events: DataFrame, after: int, size: int) -> DataFrame:
    """The next events of an append-only log: a reader resumes by the last sequence it saw."""
    return events.where(F.col("sequence") > after).orderBy("sequence").limit(size)


def exploratory(calls: DataFrame, outcomes: DataFrame, most: int = 10_000) -> DataFrame:
    """A set of calls (at most `most`) with the latest outcome of each claim."""
    head = outcomes.groupBy("call_id", "claim_no").agg(F.max_by("state", F.struct("created_at", "outcome_id")).alias("state"))
    chosen = calls.select("call_id").distinct()
    checked = chosen.crossJoin(F.broadcast(chosen.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    checked = checked.where(F.when(F.col("_n") <= most, True).otherwise(F.raise_error(F.lit("too_many_calls")).cast("boolean")))
    return checked.drop("_n").join(head, "call_id", "left")
