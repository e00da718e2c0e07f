"""Set-wise building blocks: latest row, as-of, overlap, exact medians, greedy selections, paging."""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbar.operators.folds import folded, numbered
from quillbar.session import written


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality with each value that is given; None leaves a column open."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == kv[1]), wanted.items(), df)


def between(at: Column, start, end) -> Column:
    """Half-open."""
    return (at >= start) & (at < end)


def overlap(start: Column, end: Column, other_start, other_end) -> Column:
    return (start < other_end) & (end > other_start)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of its key at or before its time; one shuffle."""
    nulls = [F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values]
    rest = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, *rest, *nulls, F.lit(1).alias("_side"))
    b = right.select(*keys, at, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], *[F.col(v).alias(f"_{v}") for v in values], F.lit(0).alias("_side"))
    w = W.partitionBy(*keys).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b).select(*keys, at, *rest, "_side", *[F.last(f"_{v}", ignorenulls=True).over(w).alias(v) for v in values])
    return both.where("_side = 1").drop("_side")


#: Widest and narrowest slot, in seconds, by which points and spans meet; points, or spans, that a group holds on average at most; rows
#: of a side that a task gets; rows of a chunk.
SLOTS, HELD, DEALT, CHUNK = (60, 86_400), 250_000, 50_000, 72


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Points inside spans [start, end] of the same key. Both meet by slots of time as wide as the longest span, a minute at least and a
    day at most, so a span lies in two slots or, if it is longer than a day, in those of its days. Slots of more than HELD spans or points
    are cut into parts, each of which meets all parts of the other side, so the tables that tasks hold stay small whatever the data. Chunks
    of neighbours in time are joined, not rows: pairs come as rectangles, in which the same spans follow each point, so that written pairs
    take a bit or two each."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    longest = spans.agg(F.max(micros(F.col("end")) - micros(F.col("start"))).alias("m")).first()["m"] or 0
    width = min(max(-(-longest // 1_000_000), SLOTS[0]), SLOTS[1]) * 1_000_000
    slot = lambda c: F.floor(micros(c) / width)
    dealt = spans.where(F.col("start") <= F.col("end")).withColumn("_slot", F.explode(F.sequence(slot(F.col("start")), slot(F.col("end")))))
    asked = points.withColumn("_slot", slot(F.col(at))).where("_slot is not null")

    def size(df: DataFrame) -> tuple[int, int]:
        """Parts of a slot, and all rows."""
        n = df.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("n"))
        most, every = n.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return max(1, -(-most // HELD)), every

    (span_parts, n_spans), (point_parts, n_points) = size(dealt), size(asked)
    tasks = max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(n_spans * point_parts, n_points * span_parts) // DEALT))
    by = [*keys, "_slot", "_part"]

    def chunks(df: DataFrame, rows: str, columns: list[str], parts: int, others: int, part, start: str, end: str) -> DataFrame:
        """Each row is in one of its side's parts, meets every part of the other side, and lies there in a chunk by time."""
        own = F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
        other = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        placed = other.withColumn("_part", part(own, F.col("_other"))).drop("_other").repartition(tasks, *by)
        chunk = F.floor((F.row_number().over(W.partitionBy(*by).orderBy(start)) - 1) / CHUNK)
        row = F.struct(*[c for c in columns if c not in keys])
        return placed.withColumn("_chunk", chunk).groupBy(*by, "_chunk").agg(F.collect_list(row).alias(rows), F.min(start).alias(f"{rows}_from"), F.max(end).alias(f"{rows}_to")).drop("_chunk")

    held = chunks(asked, "_points", points.columns, point_parts, span_parts, lambda own, other: other * point_parts + own, at, at).hint("shuffle_hash")
    met = chunks(dealt, "_spans", spans.columns, span_parts, point_parts, lambda own, other: own * point_parts + other, "start", "end").join(held, by)
    near = met.where((F.col("_points_to") >= F.col("_spans_from")) & (F.col("_points_from") <= F.col("_spans_to")))
    pairs = near.select(*keys, F.inline("_points"), "_spans").withColumn("_span", F.explode("_spans")).drop("_spans")
    return pairs.where((F.col(at) >= F.col("_span.start")) & (F.col(at) <= F.col("_span.end"))).select("*", "_span.*").drop("_span")


def either(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], distinct: list[str]) -> DataFrame:
    """left joined to right where the first or the second pair of columns is equal: two hash joins."""
    found = [left.join(right, left[a] == right[b]) for a, b in (first, second)]
    return found[0].unionByName(found[1]).dropDuplicates(distinct)


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "key", "value")


def ancestry(df: DataFrame, node: str, parent: str) -> DataFrame:
    """node, ancestor, level of every chain of parents, of any depth. Rounds double the levels that are
    known, so a chain of a thousand takes ten of them; each round is written. A circle is an error."""
    links = df.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).where("ancestor is not null").distinct()
    known = written(links.withColumn("level", F.lit(1)), "ancestry")
    nodes, reach = known.count(), 1
    while True:
        # Chains of exactly `reach` levels go on with all that is known of their end.
        further = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("level").alias("_more"))
        longer = known.where(F.col("level") == reach).join(further, "ancestor")
        longer = written(longer.select("node", F.col("_next").alias("ancestor"), (F.col("level") + F.col("_more")).alias("level")), "ancestry")
        deepest = longer.agg(F.max("level").alias("level")).first()["level"]
        if deepest is None:
            return known
        if deepest > nodes:
            raise ValueError("ancestry_has_a_circle")
        known, reach = known.unionByName(longer), reach * 2


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of the middle one or two values of each key."""
    w = W.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    middle = (F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor((F.col("_n") + 2) / 2))
    return ranked.where(middle).groupBy(*keys).agg(F.avg(value).alias("median"))


def counts_of(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of each of the fixed values, 0 for those without any."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{column} string")
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def equal_weight_rate(df: DataFrame, group: str, entity: str, win: Column, valid: Column) -> DataFrame:
    """Mean over entities of their own win rates; entities without valid samples are counted apart."""
    each = df.groupBy(group, entity).agg(F.count_if(valid & win).alias("w"), F.count_if(valid).alias("v"))
    return each.groupBy(group).agg(F.avg(F.try_divide("w", "v")).alias("rate"), F.count_if(F.col("v") > 0).alias("n_entities"), F.count_if(F.col("v") == 0).alias("n_missing"))


def ordered_list(value: Column, order: Column) -> Column:
    """Aggregate: the values of a group in the given order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def count_map(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Each key with a map from the column's values to numbers of rows."""
    n = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias("counts"))


def empirical_rank(samples: DataFrame, asked: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """Share of a key's samples strictly below each asked score; null without samples. Samples and
    questions are merged in one order, so nothing is multiplied out."""
    rest = [c for c in asked.columns if c not in keys]
    a = asked.select(*keys, *rest, F.col(score).alias("_x"), F.lit(0).alias("_s"))
    b = samples.select(*keys, *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest], F.col(value).alias("_x"), F.lit(1).alias("_s"))
    w = W.partitionBy(*keys)
    below = F.sum("_s").over(w.orderBy("_x")) - F.sum("_s").over(W.partitionBy(*keys, "_x"))
    both = a.unionByName(b).withColumn("_x", F.col("_x").cast("double"))
    return both.select(*keys, *rest, "_s", F.try_divide(below, F.nullif(F.sum("_s").over(w), F.lit(0))).alias("rarity")).where("_s = 0").drop("_s")


def page(df: DataFrame, order: list, size: int, after: tuple | None = None, columns: list[str] | None = None) -> DataFrame:
    """The next `size` + 1 rows of a descending order after a row value; the extra one tells of more."""
    if after is not None:
        df = df.where(F.struct(*columns) < F.struct(*[F.lit(x).cast(df.schema[c].dataType).alias(c) for x, c in zip(after, columns, strict=True)]))
    return df.orderBy(*order).limit(size + 1)


def snapshot_cursor(run: str, filters: dict[str, str]) -> str:
    """Names a frozen run and its filters; a cursor of another run or filter is refused by check_cursor."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([run, filters], sort_keys=True).encode()).hexdigest()


def check_cursor(cursor: str, run: str, filters: dict[str, str]) -> None:
    if cursor != snapshot_cursor(run, filters):
        raise ValueError("cursor_mismatch")


def diversity_cap(ranked: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """At most `most` rows a key, best first."""
    return ranked.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


#: Rows of a key that a block of time holds on average, if its spans are not wider.
BLOCK_ROWS = 20_000


def _decided(start: np.ndarray, end: np.ndarray, inside: np.ndarray, conflict) -> np.ndarray:
    """1 kept, 0 undecided, -1 dropped, of the rows of a block, best first. A row stays if no better one that is kept or undecided
    conflicts with it; whether rows beyond the block do is known of those inside only."""
    out, widest = np.zeros(len(start), np.int8), (end - start).max()
    near = {1: ([], []), 0: ([], [])}  # sorted starts, with the end of each beside it
    for i in range(len(start)):
        lo, hi = start[i] - widest, max(end[i], start[i] + widest)
        for state, (starts, ends) in near.items():
            a, b = bisect.bisect_left(starts, lo), bisect.bisect_right(starts, hi)
            if any(conflict(start[i], end[i], x, y) for x, y in zip(starts[a:b], ends[a:b], strict=True)):
                out[i] = -1 if state else 0
                break
        else:
            out[i] = 1 if inside[i] else 0
        if out[i] >= 0:
            starts, ends = near[int(out[i])]
            at = bisect.bisect_left(starts, start[i])
            starts.insert(at, start[i])
            ends.insert(at, end[i])
    return out


def _suppressed(ranked: DataFrame, keys: list[str], conflict) -> DataFrame:
    """Greedy, best first: a row stays unless it conflicts with a kept one, which only rows do whose starts are less than the
    widest span of the key apart. Rounds over blocks of time, shifted by half a block each time: a block decides the rows that
    depend on none beyond it, and what is left goes on. No group holds more than a block, however the spans bridge each other.
    conflict(start, end, start, end): of two rows."""
    stats = ranked.groupBy(*keys).agg(F.min("start").alias("_lo"), F.max("start").alias("_hi"), F.max(F.col("end") - F.col("start")).alias("_wide"), F.count(F.lit(1)).alias("_n"))
    long = F.greatest(4 * F.col("_wide"), (F.col("_hi") - F.col("_lo")) * BLOCK_ROWS / F.col("_n"), F.lit(1e-9)).cast("double")
    stats = stats.withColumn("_long", long).withColumn("_pair", F.struct(*keys)).select("_pair", "_lo", "_hi", "_wide", "_long")
    left = written(ranked.join(stats, F.struct(*[ranked[k] for k in keys]).eqNullSafe(F.col("_pair"))).drop("_pair"), "undecided")
    schema = T.StructType([*left.schema.fields, T.StructField("_state", T.ByteType())])

    def block(shift: float):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
            number = rows.pop("_block").iloc[0] - shift
            lo, hi, wide, width = (rows[c].iloc[0] for c in ("_lo", "_hi", "_wide", "_long"))
            start, end = rows["start"].to_numpy(), rows["end"].to_numpy()
            begin, over = lo + number * width, lo + (number + 1) * width
            inside = ((begin <= lo) | (start - wide >= begin)) & ((over > hi) | (start + wide < over))
            state = _decided(start, end, inside, conflict)
            return rows.assign(_state=state)[state >= 0]

        return run

    kept, shift = [], 0.0
    while True:
        number = F.floor((F.col("start") - F.col("_lo")) / F.col("_long") + shift).cast("long")
        found = written(left.withColumn("_block", number).groupBy(*keys, "_block").applyInPandas(block(shift), schema), "decided")
        kept.append(found.where("_state = 1").select(*ranked.columns))
        left = found.where("_state = 0").drop("_state")
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, kept)
        shift = 0.5 - shift


def nms_half_width(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Drops rows whose start (a number) is within half a width of a better kept one of their key."""
    return _suppressed(ranked, keys, lambda a, b, c, d: abs(a - c) < max(b - a, d - c) / 2)


def nms_overlap(ranked: DataFrame, keys: list[str], most: float = 0.5) -> DataFrame:
    """Drops rows that share over `most` of the shorter span with a better kept one of their key."""
    return _suppressed(ranked, keys, lambda a, b, c, d: min(b, d) - max(a, c) > most * min(b - a, d - c))


def runner_ups(ranked: DataFrame, keys: list[str], others: int = 2) -> DataFrame:
    """The best row of each key and the next ones that overlap none before them."""
    kept = _suppressed(ranked, keys, lambda a, b, c, d: a < d and b > c)
    return diversity_cap(kept, keys, [F.desc("score"), "id"], others + 1)


def fetch_groups(ranges: DataFrame, keys: list[str], most: int = 2000) -> DataFrame:
    """Sorted ranges of bars (start, end as numbers) joined greedily while a group stays within `most`; a
    fold over sorted ranges that holds one group."""
    names = [*keys, "start", "end", "n_ranges"]

    class Fold:
        def __init__(self, key):
            self.key, self.now = key, None

        def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for a, b in zip(pdf["start"].tolist(), pdf["end"].tolist(), strict=True):
                if self.now and max(self.now[1], b) - self.now[0] <= most:
                    self.now = (self.now[0], max(self.now[1], b), self.now[2] + 1)
                else:
                    out += [(*self.key, *self.now)] if self.now else []
                    self.now = (a, b, 1)
            return pd.DataFrame(out, columns=names)

        def done(self) -> pd.DataFrame:
            return pd.DataFrame([(*self.key, *self.now)], columns=names)

    kinds = ", ".join(f"{k} {ranges.schema[k].dataType.simpleString()}" for k in keys)
    return folded(ranges.select(*keys, "start", "end"), keys, ["start", "end"], Fold, f"{kinds}, start long, end long, n_ranges long")


def fair_queue(waiting: DataFrame, running: DataFrame, capacity: dict[str, int]) -> DataFrame:
    """Jobs to start: by the owner's last turn, then run_after, created, id, up to each queue's free places."""
    slots = running.sparkSession.createDataFrame(list(capacity.items()), "queue string, slots int")
    busy = running.groupBy("queue").agg(F.count(F.lit(1)).alias("busy"))
    free = slots.join(busy, "queue", "left").select("queue", (F.col("slots") - F.coalesce("busy", F.lit(0))).alias("free"))
    order = W.partitionBy("queue").orderBy(F.asc_nulls_first("last_turn"), "run_after", "created", "id")
    return waiting.withColumn("_n", F.row_number().over(order)).join(F.broadcast(free), "queue").where("_n <= free").drop("_n", "free")


def retained_difference(features: DataFrame, retained: DataFrame, key: str) -> DataFrame:
    """Features that the new list does not keep."""
    return features.join(retained.select(key), key, "left_anti")


def borda(df: DataFrame, first: str, second: str, tie: str, unknown: Column | None = None) -> DataFrame:
    """Sum of the ranks by two measures, greatest first; ties by name. Rows that lack a measure, or that
    `unknown` marks (a contract without known size has no turnover), are left out."""
    known = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    known = known if unknown is None else known.where(~F.coalesce(unknown, F.lit(False)))
    both = numbered(numbered(known, [F.desc(first), tie], "rank_first"), [F.desc(second), tie], "rank_second")
    return numbered(both.withColumn("score", F.col("rank_first") + F.col("rank_second")), ["score", tie], "place")


def top_snapshot(ranked: DataFrame, n: int, taken_at) -> DataFrame:
    return ranked.where(F.col("place") <= n).withColumn("taken_at", F.lit(taken_at))
