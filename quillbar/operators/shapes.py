"""Chart shapes: descriptors, warped comparison, sweeps, and vector search with its selections.

Kernels are small numpy functions; Spark deals the contracts or candidates they run on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbar.functions.text import nearest_two
from quillbar.operators.folds import folded
from quillbar.operators.relational import diversity_cap, first_by, interval_join, nms_half_width, nms_overlap

POINTS, WARP, STEP_COST = 64, 6, 0.025
#: Weights of open, high, low, close in a warped comparison.
WEIGHTS = np.array([0.25, 0.2, 0.2, 0.35])
EPS = 1e-9


def normalize(ohlc: np.ndarray, reverse: bool = False) -> np.ndarray:
    """64 x 4 candles between the 2nd percentile of lows (0) and the 98th of highs (1), or between the
    extremes if those coincide. reverse: upside down."""
    n = len(ohlc)
    if not 16 <= n <= 2000 or not np.isfinite(ohlc).all():
        raise ValueError("invalid_chart_geometry")
    o, h, low, c = ohlc.T
    if (h < np.maximum(o, c)).any() or (low > np.minimum(o, c)).any():
        raise ValueError("invalid_chart_geometry")
    top, bottom = np.quantile(h, 0.98), np.quantile(low, 0.02)
    if top - bottom <= EPS:
        top, bottom = h.max(), low.min()
    if top - bottom <= EPS:
        raise ValueError("flat_chart_geometry")
    at = np.arange(POINTS) * (n - 1) / (POINTS - 1)
    i = np.minimum(at.astype(int), n - 2)
    points = ohlc[i] + (ohlc[i + 1] - ohlc[i]) * (at - i)[:, None]
    points = (points - bottom) / (top - bottom)
    return 1 - points[:, [0, 2, 1, 3]] if reverse else points


def descriptor(ohlc: np.ndarray) -> np.ndarray:
    """192 numbers: centre, half range and step of each of 64 points, of length 1."""
    p = normalize(ohlc)
    centre = (p[:, 0] + p[:, 3]) / 2
    step = np.diff(centre, prepend=centre[0])
    flat = np.stack([centre - 0.5, (p[:, 1] - p[:, 2]) / 2, step * 2], 1).ravel().astype(np.float32)
    size = np.sqrt((flat * flat).sum(dtype=np.float32))
    if size <= 1e-6:
        raise ValueError("flat_chart_geometry")
    return flat / size


def warped(a: np.ndarray, b: np.ndarray) -> float:
    """Score in (0, 1] of two normalized shapes: banded dynamic time warping with a price on steps, and a
    penalty on the difference of their net moves."""
    return float(warped_all(a, b[None])[0])


def warped_all(a: np.ndarray, many: np.ndarray) -> np.ndarray:
    """warped() of one shape with each of many (count x 64 x 4), cell by cell for all of them together."""
    before = np.full((POINTS + 1, len(many)), np.inf)
    before[0] = 0
    for i in range(POINTS):
        lo, hi = max(0, i - WARP), min(POINTS, i + WARP + 1)
        cost = (np.abs(many[:, lo:hi] - a[i]) * WEIGHTS).sum(2).T
        now = np.full_like(before, np.inf)
        for j in range(lo, hi):
            now[j + 1] = cost[j - lo] + np.minimum(before[j], np.minimum(before[j + 1], now[j]) + STEP_COST)
        before = now
    net = np.abs((a[-1, 3] - a[0, 0]) - (many[:, -1, 3] - many[:, 0, 0]))
    return np.exp(-6 * (before[-1] / POINTS + 0.15 * net))


def same_direction(a: np.ndarray, b: np.ndarray) -> bool:
    x, y = a[-1, 3] - a[0, 0], b[-1, 3] - b[0, 0]
    return min(abs(x), abs(y)) < 0.08 or (x > 0) == (y > 0)


def flipped(ohlc: np.ndarray) -> np.ndarray:
    """Open and close swapped: the other reading of candle colours."""
    return ohlc[:, [3, 1, 2, 0]]


def priced(query: np.ndarray, candidate: np.ndarray) -> float:
    """Score of two charts with true prices: by the median relative error over 64 x 4 points."""
    both = []
    for x in (query, candidate):
        at = np.arange(POINTS) * (len(x) - 1) / (POINTS - 1)
        i = np.minimum(at.astype(int), len(x) - 2)
        both.append(x[i] + (x[i + 1] - x[i]) * (at - i)[:, None])
    error = np.abs(both[0] - both[1]) / np.maximum(np.abs(both[1]), 1e-9)
    return float(np.exp(-200 * np.median(error)))


def sweep(query: np.ndarray, series: np.ndarray, shortest: int, longest: int, step: int) -> list[tuple[float, int, int]]:
    """(score, start, length) of every window of every length, best first; windows without shape are
    left out."""
    q, out = normalize(query), []
    for n in range(max(shortest, 16), min(longest, len(series), 2000) + 1, step):
        starts, shaped = [], []
        for start in range(len(series) - n + 1):
            try:
                shaped.append(normalize(series[start : start + n]))
                starts.append(start)
            except ValueError:
                continue
        for lo in range(0, len(starts), 512):
            scores = warped_all(q, np.stack(shaped[lo : lo + 512]))
            out += zip(scores.tolist(), starts[lo : lo + 512], [n] * len(scores), strict=True)
    return sorted(out, key=lambda x: -x[0])


def located(query: np.ndarray, series: np.ndarray, n: int, band: tuple[int, int] | None = None) -> dict | None:
    """Where in a series of bars a chart of about n bars was taken: the best window of 90 to 110 per cent in either
    reading of colours, the next best ones that overlap none before them, and how far the best stands out
    of all. band: (place of the last bar, bars it may be off); None if nothing fits."""
    if len(series) < 16 or len(query) < 16:
        return None
    shortest, longest = max(16, n * 9 // 10), min(len(series), n * 11 // 10)
    found = max((sweep(x, series, shortest, longest, 2) for x in (query, flipped(query))), key=lambda f: f[0][0] if f else 0.0)
    fit = found if band is None else [x for x in found if abs(x[1] + x[2] - 1 - band[0]) <= band[1]]
    if not fit:
        return None
    best, others = fit[0], []
    for x in found:
        if len(others) < 2 and all(x[1] >= y[1] + y[2] or y[1] >= x[1] + x[2] for y in (best, *others)):
            others.append(x)
    scores = np.array([x[0] for x in found])
    spread = scores.std()
    return {"score": best[0], "start": best[1], "length": best[2], "second": others[0][0] if others else 0.0, "z": float((best[0] - scores.mean()) / spread) if spread > 1e-9 else 0.0}


def locate(query: np.ndarray, rows: DataFrame, n: int) -> DataFrame:
    """located() of each row (id, ohlc: array of arrays of four doubles; optionally last, slack: its band)."""
    kind = "score double, start int, length int, second double, z double"
    banded = "last" in rows.columns

    def run(batches):
        names = ["score", "start", "length", "second", "z"]
        for pdf in batches:
            bands = zip(pdf["last"], pdf["slack"], strict=True) if banded else [None] * len(pdf)
            found = [located(query, np.stack(x), n, None if b is None or pd.isna(b[0]) else (int(b[0]), int(b[1]))) for x, b in zip(pdf["ohlc"], bands, strict=True)]
            got = pd.DataFrame([{k: None if f is None else f[k] for k in names} for f in found], columns=names, index=pdf.index)
            yield pd.concat([pdf[["id"]], got.astype({"start": "Int64", "length": "Int64"})], axis=1)

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, {kind}")


def normalize_all(series: np.ndarray, n: int, start: int = 0, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, shapes) of normalize() of the windows of n bars that begin at start and after it; those without shape are left out."""
    last = len(series) - n + 1
    starts = np.arange(start, last if count is None else min(last, start + count))
    if not len(starts) or not 16 <= n <= 2000:
        return starts[:0], np.zeros((0, POINTS, 4))
    o, h, low, c = series.T
    with np.errstate(invalid="ignore"):
        bad = ~np.isfinite(series).all(1) | (h < np.maximum(o, c)) | (low > np.minimum(o, c))
    spoilt = np.concatenate([[0], np.cumsum(bad)])
    starts = starts[spoilt[starts + n] == spoilt[starts]]
    if not len(starts):
        return starts, np.zeros((0, POINTS, 4))
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, n)[starts]
    highs, lows = view(h), view(low)
    top, bottom = np.quantile(highs, 0.98, axis=1), np.quantile(lows, 0.02, axis=1)
    narrow = top - bottom <= EPS
    top, bottom = np.where(narrow, highs.max(1), top), np.where(narrow, lows.min(1), bottom)
    kept = top - bottom > EPS
    starts, top, bottom = starts[kept], top[kept], bottom[kept]
    at = np.arange(POINTS) * (n - 1) / (POINTS - 1)
    i = np.minimum(at.astype(int), n - 2)
    first = series[starts[:, None] + i]
    points = first + (series[starts[:, None] + i + 1] - first) * (at - i)[None, :, None]
    return starts, (points - bottom[:, None, None]) / (top - bottom)[:, None, None]


def _most_scores(a: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Upper bounds of warped_all(a, many): each point of a candidate is matched with one of the band's, so it costs what it lies outside the
    band's extremes at least; the first and the last points are matched with each other."""
    ends = [(np.abs(many[:, j] - a[j]) * WEIGHTS).sum(1) for j in (0, POINTS - 1)]
    band = [slice(max(0, j - WARP), min(POINTS, j + WARP + 1)) for j in range(POINTS)]
    top, bottom = (np.stack([side(a[x], axis=0) for x in band]) for side in (np.max, np.min))
    outside = (np.maximum(0, np.maximum(many - top, bottom - many)) * WEIGHTS).sum(2)
    cost = ends[0] + outside[:, 1:-1].sum(1) + ends[1]
    net = np.abs((a[-1, 3] - a[0, 0]) - (many[:, -1, 3] - many[:, 0, 0]))
    return np.exp(-6 * (cost / POINTS + 0.15 * net))


#: Windows that are normalised together, and warped together.
WINDOWS, WARPED = 1024, 64


def best_window(query: np.ndarray, series: np.ndarray, counted: list | None = None) -> tuple[float, int, int] | None:
    """The best window of 85 to 115 per cent of the query's length, in either reading of colours: that of the whole sweep, but only windows
    whose bound reaches the best score so far are warped. counted: gains (windows, warped)."""
    n, best, seen, done = len(query), None, 0, 0
    shapes = [normalize(query), normalize(flipped(query))]
    for turn, q in enumerate(shapes):
        found = None
        for size in range(max(n * 85 // 100, 16), min(n * 115 // 100, len(series), 2000) + 1, 4):
            for lo in range(0, len(series) - size + 1, WINDOWS):
                starts, shaped = normalize_all(series, size, lo, WINDOWS)
                seen += len(starts)
                most = _most_scores(q, shaped) + 1e-12
                for part in range(0, len(starts), WARPED):
                    order = np.argsort(-most, kind="stable")[part : part + WARPED]
                    least = max((x[0] for x in (best, found) if x), default=-1.0)
                    order = order[most[order] >= least]
                    if not len(order):
                        break
                    done += len(order)
                    scores = warped_all(q, shaped[order])
                    # Of equal scores the shortest and earliest window counts, as in the sweep.
                    top = order[scores == scores.max()].min()
                    candidate = (float(scores.max()), int(starts[top]), size)
                    if found is None or (-candidate[0], candidate[2], candidate[1]) < (-found[0], found[2], found[1]):
                        found = candidate
        if found and (best is None or found[0] > best[0]):
            best = found
    if counted is not None:
        counted.append((seen, done))
    return best


def recall_distance(query: np.ndarray, candidate: np.ndarray, bars: int, indexed: int) -> float:
    """Least distance of two descriptors over stretches of 85 to 115 per cent, by 32 points of centre and
    half range scaled to the unit interval."""
    if len(query) != 192 or len(candidate) != 192 or not bars or not indexed or not (np.isfinite(query).all() and np.isfinite(candidate).all()):
        return float("inf")

    def segment(v, start, size):
        at = start + np.arange(32) * (size - 1) / 31
        i = np.minimum(at.astype(int), POINTS - 2)
        centre, half = (x[i] + (x[i + 1] - x[i]) * (at - i) for x in (v.reshape(POINTS, 3)[:, 0], v.reshape(POINTS, 3)[:, 1]))
        low, high = (centre - half).min(), (centre + half).max()
        span = max(high - low, 1e-9)
        return (centre - low) / span, half / span

    best = float("inf")
    for pct in range(85, 116, 5):
        part = bars * pct / 100 / indexed
        whole, scanned = (query, candidate) if part <= 1 else (candidate, query)
        size = float(np.clip(POINTS * min(part, 1 / part), 16, 64))
        fixed = segment(whole, 0, POINTS)
        steps = int(np.ceil((POINTS - size) / 2))
        for k in range(steps + 1):
            moved = segment(scanned, (POINTS - size) * k / steps if steps else 0.0, size)
            best = min(best, float(np.mean(np.abs(fixed[0] - moved[0]) + 0.25 * np.abs(fixed[1] - moved[1]))))
    return best


def windows(bars: DataFrame, size: int, stride: int, key: str = "symbol") -> DataFrame:
    """Index rows of every window of `size` bars at the stride, without holes: start, end, descriptor and
    a content id that names the same window again. Bars stream by; a window's length of them is held."""

    class Fold:
        def __init__(self, found):
            self.key, self.held, self.skip = found[0], None, 0

        def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf if self.held is None else pd.concat([self.held, pdf])
            ohlc, start, end = pdf[["open", "high", "low", "close"]].to_numpy(np.float64), pdf["start"].to_numpy(), pdf["end"].to_numpy()
            rows, at = [], self.skip
            while at + size <= len(pdf):
                part = slice(at, at + size)
                if (end[part][:-1] == start[part][1:]).all():
                    try:
                        rows.append((self.key, start[at], end[at + size - 1], descriptor(ohlc[part]).tolist()))
                    except ValueError:
                        pass
                at += stride
            kept = min(at, len(pdf))
            self.held, self.skip = pdf.iloc[kept:], at - kept
            return pd.DataFrame(rows, columns=[key, "start", "end", "embedding"])

        def done(self) -> None:
            return None

    kind = bars.schema[key].dataType.simpleString()
    rows = bars.select(key, "start", "end", "open", "high", "low", "close")
    found = folded(rows, [key], ["start"], Fold, f"{key} {kind}, start timestamp_ntz, end timestamp_ntz, embedding array<float>")
    return found.withColumn("feature_id", F.md5(F.to_json(F.struct(key, "start", "end", F.lit(size).alias("bars"), "embedding"))))


def add_features(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored with the features whose content it lacks: writing the same block again changes nothing."""
    return stored.unionByName(fresh.dropDuplicates(["feature_id"]).join(stored.select("feature_id"), "feature_id", "left_anti").select(*stored.columns))


def published(features: DataFrame, links: DataFrame, generations: DataFrame) -> DataFrame:
    """Features linked from a generation that is ready, with the latest of those."""
    ready = links.join(generations.where("status = 'ready'"), "generation_id")
    latest = first_by(ready, ["feature_id"], [F.desc("created_at"), F.desc("generation_id")])
    return features.join(latest.select("feature_id", "generation_id"), "feature_id")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, query: list[float], k: int, excluded: tuple[int, ...] = (), pool: int | None = None) -> DataFrame:
    """The k rows nearest to one query by cosine distance, exactly: a scan and a bounded top-k, after the
    exclusions; ties by id. pool: rows of the first of two selections."""
    distance = 1 - cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    scored = rows.where(~F.col("id").isin(list(excluded))) if excluded else rows
    scored = scored.withColumn("distance", distance)
    if pool:
        scored = scored.orderBy("distance", "id").limit(pool)
    return scored.orderBy(F.col("distance") + 0, "id").limit(k)


#: Bytes of queries that are broadcast together, and queries whose products with a batch of rows are held at once.
QUERY_BYTES, TOGETHER = 4 << 20, 256


def nearest_of_many(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, rank of the k rows nearest to each query by cosine distance, exactly, ties by id.
    rows: id, embedding, model, market, symbol, end; queries: query_id, embedding, model and, null where open, market,
    symbol, cutoff (rows must end by it) and excluded (ids). Every task keeps the k best of its rows for each
    query. Queries are broadcast in slices of a stated size, and one scan serves a slice."""
    total = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("w")).first()
    slices = max(1, -(-8 * total["n"] * total["w"] // QUERY_BYTES))
    parts = [_nearest_of_slice(rows, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i), k) for i in range(slices)]
    return reduce(DataFrame.unionByName, parts)


def _nearest_of_slice(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window as W

    asked = [r.asDict() for r in queries.collect()]  # at most QUERY_BYTES
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    kinds = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"id {rows.schema['id'].dataType.simpleString()}", "distance double"]

    def run(batches):
        by_model = {}
        for q in shared.value:
            by_model.setdefault((q["model"], len(q["embedding"])), []).append(q)
        asks = {m: np.array([q["embedding"] for q in own], np.float64) for m, own in by_model.items()}
        best = {}  # query -> ids and distances of its k best rows of this partition
        for pdf in batches:
            if not len(pdf):
                continue
            for (model, width), part in pdf.groupby(["model", pdf["embedding"].map(len)]):
                if (model, width) not in by_model:
                    continue
                data, ids, end = np.array(part["embedding"].tolist(), np.float64), part["id"].to_numpy(), part["end"]
                size = np.sqrt((data * data).sum(1))
                unit = data / np.where(size > 0, size, np.inf)[:, None]
                own, kinds = by_model[model, width], {}
                for name in ("market", "symbol"):
                    codes, names = pd.factorize(part[name])
                    kinds[name] = codes, {v: i for i, v in enumerate(names)}
                for lo in range(0, len(own), TOGETHER):
                    near = asks[model, width][lo : lo + TOGETHER] @ unit.T  # queries x rows, one product
                    for n, q in enumerate(own[lo : lo + TOGETHER], lo):
                        vector = asks[model, width][n]
                        norm = np.sqrt((vector * vector).sum())
                        old = best.get(q["query_id"], (ids[:0], np.zeros(0)))
                        # What a product may confuse with the k-th stays.
                        full = len(old[0]) >= k and np.isfinite(old[1][-1])
                        at = np.flatnonzero((near[n - lo] >= (1 - old[1][-1] - 1e-9) * norm) & (size > 0) if full else size > 0)
                        if not len(at):
                            continue
                        ok = ~np.isin(ids[at], q.get("excluded") or [])
                        for name, (codes, names) in kinds.items():
                            if q.get(name) is not None:
                                ok &= codes[at] == names.get(q[name], -2)
                        if q.get("cutoff") is not None:
                            ok &= (end.iloc[at] <= q["cutoff"]).to_numpy(bool)
                        at = at[ok]
                        if len(at) > k:
                            some = near[n - lo][at]
                            at = at[some >= np.partition(some, len(at) - k)[len(at) - k] - 1e-9 * max(norm, abs(some).max())]
                        distance = 1 - (data[at] * vector).sum(1) / (size[at] * norm)
                        both = np.concatenate([old[0], ids[at]]), np.concatenate([old[1], distance])
                        first = np.lexsort(both)[:k]
                        best[q["query_id"]] = both[0][first], both[1][first]
        names = [n for n, (found, _) in best.items() for _ in found]
        if names:
            yield pd.DataFrame({"query_id": names, "id": np.concatenate([x for x, _ in best.values()]), "distance": np.concatenate([x for _, x in best.values()])})

    found = rows.where("embedding is not null").select("id", "embedding", "model", "market", "symbol", "end").mapInPandas(run, ", ".join(kinds))
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidates(ranked: DataFrame, contract: list[str], budget: int = 300) -> DataFrame:
    """Public candidates: greedy suppression of near starts and three a contract, within the budget.
    ranked: contract columns, id, score, start, end (numbers)."""
    kept = diversity_cap(nms_half_width(ranked, contract), contract, [F.desc("score"), "id"], 3)
    return kept.orderBy(F.desc("score"), "id").limit(budget)


def public_candidates(features: DataFrame, query: list[float], bars: int, contract: list[str], cutoff: Column, pool: int = 10_000, budget: int = 300, excluded: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(candidates, one row with how many had no proof of their source). The pool nearest by cosine among published
    windows of the two nearest lengths that end by the cutoff, ranked again by the aligned distance of
    descriptors, then suppressed and capped by contract. features: contract columns, id, embedding, bars, start,
    end (numbers), published, generation_id (null: unproven)."""
    sizes = nearest_two([64, 128, 256], F.lit(bars))
    able = features.where(F.col("published") & (F.col("end") <= cutoff) & F.array_contains(sizes, F.col("bars")))
    found = nearest(able, query, pool, excluded)
    unproven = found.agg(F.count_if(F.col("generation_id").isNull()).alias("unproven"))
    vector = np.asarray(query, np.float32)

    @F.pandas_udf(T.DoubleType())
    def aligned(embedding: pd.Series, indexed: pd.Series) -> pd.Series:
        return pd.Series([recall_distance(vector, np.asarray(x, np.float32), bars, int(n)) for x, n in zip(embedding, indexed, strict=True)], dtype=float)

    scored = found.where("generation_id is not null").withColumn("score", -aligned("embedding", "bars")).where(F.col("score") > float("-inf"))
    return candidates(scored.select(*contract, "id", "score", "start", "end"), contract, budget), unproven


def exact_rerank(query: np.ndarray, chosen: DataFrame, bars: DataFrame, key: str = "symbol") -> DataFrame:
    """id, status, score, at, length: the best window of each candidate's own bars. A candidate whose bars no
    longer have the hash it was indexed with is `source_changed`, one without bars `source_missing`, and neither is
    scored. chosen: id, key, start, end (times), source_hash; see source_hash()."""
    spans = chosen.select(key, "id", "start", "end", "source_hash")
    points = bars.select(key, F.col("start").alias("_at"), F.col("end").alias("_end"), "open", "high", "low", "close")
    met = interval_join(points, spans, [key], "_at").where((F.col("_at") < F.col("end")) & (F.col("_end") <= F.col("end")))
    grouped = met.groupBy("id").agg(source_hash("_at").alias("_hash"), F.transform(F.sort_array(F.collect_list(F.struct("_at", "open", "high", "low", "close"))), lambda x: F.array(x["open"], x["high"], x["low"], x["close"])).alias("ohlc"))
    joined = chosen.select("id", "source_hash").join(grouped, "id", "left")
    status = F.when(F.col("_hash").isNull(), "source_missing").when(F.col("_hash") != F.col("source_hash"), "source_changed").otherwise("exact")
    checked = joined.select("id", status.alias("status"), F.when(status == "exact", F.col("ohlc")).alias("ohlc"))
    return rerank(query, checked).select("id", "status", "score", "at", "length")


def source_hash(at: str) -> Column:
    """Aggregate: hash of a window's bars in order of time."""
    rows = F.sort_array(F.collect_list(F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("at"), "open", "high", "low", "close")))
    return F.sha2(F.to_json(rows), 256)


def repaired_lineage(features: DataFrame, links: DataFrame, generations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links to add, ids to unpublish) of published features that no generation links: the latest ready
    generation of their contract, window and model that covers them takes them; the rest lose their place. features:
    feature_id, market, symbol, interval, bars, model, start, end, published; generations: generation_id, status,
    market, symbol, interval, bars, models, start, end, published_at."""
    orphans = features.where("published").join(links.select("feature_id"), "feature_id", "left_anti")
    ready = generations.where("status = 'ready'").select("generation_id", "market", "symbol", "interval", "bars", "models", F.col("start").alias("_s"), F.col("end").alias("_e"), "published_at")
    met = orphans.join(ready, ["market", "symbol", "interval", "bars"]).where(F.array_contains("models", F.col("model")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end")))
    added = first_by(met, ["feature_id"], [F.desc_nulls_last("published_at"), "generation_id"]).select("generation_id", "feature_id")
    return added, orphans.select("feature_id").join(added.select("feature_id"), "feature_id", "left_anti")


def feedback_heads(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Feedback of a search session as an append-only log read by its latest entry a candidate. Both:
    session_id, candidate_id, verdict, created_at, feedback_id."""
    both = stored.unionByName(fresh).dropDuplicates(["feedback_id"])
    return first_by(both, ["session_id", "candidate_id"], [F.desc("created_at"), F.desc("feedback_id")])


def level(score: Column) -> Column:
    return F.when(score >= 0.75, "sure").when(score >= 0.60, "likely").when(score >= 0.45, "weak").otherwise("none")


def final_ranking(scored: DataFrame, contract: list[str], limit: int = 5, floor: float = 0.60) -> DataFrame:
    """Hits above the floor, without those that share over half of a better one or repeat one in the other
    dollar quote (where base, quote and interval are known), one a contract."""
    good = nms_overlap(scored.where((F.col("score") >= floor) & ~F.isnan("score")), contract)
    if {"base", "quote", "interval"} <= set(scored.columns):
        good = quote_variants(good)
    one = first_by(good, contract, [F.desc("score"), "id"])
    return one.orderBy(F.desc("score"), "id").limit(limit).withColumn("level", level(F.col("score")))


def quote_variants(hits: DataFrame) -> DataFrame:
    """Without hits that repeat a better one of the same base and interval in the other dollar quote, over
    half of the shorter span. hits: base, quote, interval, id, score, start, end."""
    pairs = hits.alias("a").join(hits.alias("b"), (F.col("a.base") == F.col("b.base")) & (F.col("a.interval") == F.col("b.interval")) & (F.col("a.quote") != F.col("b.quote")) & (F.struct("b.score", "a.id") > F.struct("a.score", "b.id")))
    shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    shorter = F.least(F.col("a.end") - F.col("a.start"), F.col("b.end") - F.col("b.start"))
    return hits.join(pairs.where(shared > shorter * 0.5).select(F.col("a.id").alias("id")).distinct(), "id", "left_anti")


def widened(start: Column, end: Column, cutoff: Column) -> tuple[Column, Column]:
    """A window with a quarter of its length (4 at least) on both sides, not beyond the cutoff."""
    pad = F.greatest(F.floor((end - start) / 4), F.lit(4))
    return start - pad, F.least(end + pad, cutoff)


def is_confident(ranked: DataFrame, keys: list[str], least: float = 0.75, margin: float = 0.10) -> DataFrame:
    """The top hit of each key if its score is at least `least` and no second comes within the margin."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
    top = ranked.withColumn("_r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("_r = 1").drop("_r")
    return top.withColumn("confident", (F.col("score") >= least) & F.coalesce(F.col("score") - F.col("second") >= margin, F.lit(True)))


def rerank(query: np.ndarray, rows: DataFrame) -> DataFrame:
    """score and place of the best window of each candidate's bars (id, ohlc: array of four doubles)."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("at", T.IntegerType()), T.StructField("length", T.IntegerType())])

    @F.pandas_udf(kind)
    def scored(ohlc: pd.Series) -> pd.DataFrame:
        out = [(None if x is None else best_window(query, np.stack(x))) or (None, None, None) for x in ohlc]
        return pd.DataFrame(out, columns=["score", "at", "length"])

    return rows.withColumn("_m", scored("ohlc")).select(*rows.columns, "_m.*")
