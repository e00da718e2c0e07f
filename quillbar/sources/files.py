"""File sources and sinks: mapped CSV, zipped CSV, month listings, NDJSON exports with manifests."""

from __future__ import annotations

import io
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_BYTES = 128 << 20
KLINE = "open_time long, open string, high string, low string, close string, volume string, close_time long"
TRADE = "id long, price string, quantity string, first_id long, last_id long, at long, maker string"


def _unzipped(header: tuple[str, ...], names: list[str]):
    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    members = [m for m in z.infolist() if m.filename.endswith(".csv")]
                    if len(members) != 1 or members[0].file_size > MOST_BYTES:
                        raise ValueError("archive_must_hold_one_csv")
                    with z.open(members[0]) as f:  # the CRC is proven when the member is read to its end
                        first, line = True, 0
                        for part in pd.read_csv(f, header=None, dtype=str, chunksize=50_000, keep_default_na=False):
                            if first and part.iloc[0, 0] in header:
                                part = part.iloc[1:]
                            first = False
                            if part.shape[1] < len(names):
                                raise ValueError("too_few_columns")
                            part = part.iloc[:, : len(names)]
                            part.columns = names
                            yield part.assign(path=path, line=[str(i) for i in range(line, line + len(part))])
                            line += len(part)

    return run


def zipped_klines(spark: SparkSession, paths: str) -> DataFrame:
    """Bars of zipped kline files: one CSV a file, with or without header; times are milliseconds."""
    names = ["open_time", "open", "high", "low", "close", "volume", "close_time"]
    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    text = raw.mapInPandas(_unzipped(("open_time", "openTime"), names), ", ".join(f"{n} string" for n in [*names, "path", "line"]))
    at = lambda c: F.timestamp_millis(F.col(c).cast("long")).cast("timestamp_ntz")
    return text.select("path", F.col("line").cast("long").alias("line"), at("open_time").alias("start"), F.timestamp_millis(F.col("close_time").cast("long") + 1).cast("timestamp_ntz").alias("end"), *[F.col(c).cast("decimal(38,18)").alias(c) for c in names[1:6]])


def kline_order_proof(klines: DataFrame) -> DataFrame:
    """Files whose opening times do not rise strictly."""
    before = F.lag("start").over(W.partitionBy("path").orderBy("start"))
    return klines.withColumn("_b", before).where(F.col("start") <= F.col("_b")).select("path").distinct()


def zipped_trades(spark: SparkSession, paths: str) -> DataFrame:
    names = ["id", "price", "quantity", "first_id", "last_id", "at", "maker"]
    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    text = raw.mapInPandas(_unzipped(("agg_trade_id", "id"), names), ", ".join(f"{n} string" for n in [*names, "path", "line"]))
    return text.select("path", F.col("line").cast("long").alias("line"), F.col("id").cast("long").alias("trade_id"), F.timestamp_millis(F.col("at").cast("long")).cast("timestamp_ntz").alias("at"), F.col("price").cast("decimal(38,18)").alias("price"), F.col("quantity").cast("decimal(38,18)").alias("quantity"))


def proven_klines(klines: DataFrame, start: Column, end: Column, most: int = 50_000) -> DataFrame:
    """Bars of zipped files wholly inside [start, end). A file whose opening times do not rise strictly in the
    order of its rows, or more than `most` bars, fail the job. klines: as zipped_klines gives them."""
    ordered = W.partitionBy("path").orderBy("line")
    late = F.coalesce(F.lag("start").over(ordered) >= F.col("start"), F.lit(False))
    n = F.count(F.lit(1)).over(W.partitionBy("path"))
    fail = lambda code: F.raise_error(F.lit(code)).cast("boolean")
    checked = klines.withColumn("_late", late).where(F.when(F.col("_late"), fail("kline_order_unproven")).otherwise(True))
    inside = checked.where((F.col("start") >= start) & (F.col("end") <= end)).withColumn("_n", n)
    return inside.where(F.when(F.col("_n") > most, fail("too_many_bars")).otherwise(True)).drop("_late", "_n")


def proven_trades(trades: DataFrame, day: Column) -> DataFrame:
    """Trades of zipped day files: ids rise by one, times do not fall and lie inside the day, price and quantity
    are positive; anything else fails the job. day: the file's date, from its path."""
    ordered = W.partitionBy("path").orderBy("line")
    bad = F.coalesce(F.col("trade_id") != F.lag("trade_id").over(ordered) + 1, F.lit(False))
    bad = F.when(bad, "trade_id_gap").when(F.col("at") < F.lag("at").over(ordered), "trade_time_order_unproven")
    bad = bad.when(F.col("at").cast("date") != day, "trade_outside_day").when((F.col("price") <= 0) | (F.col("quantity") <= 0), "invalid_trade")
    checked = trades.withColumn("_bad", bad)
    return checked.where(F.when(F.col("_bad").isNull(), True).otherwise(F.raise_error(F.col("_bad")).cast("boolean"))).drop("_bad")


def months_in_order(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted months (symbol, segment, month) with their files and place, in order: what is missing has a null
    path. Files are read in parallel and their rows sorted by place."""
    found = wanted.join(catalogue, ["symbol", "segment", "month"], "left")
    return found.withColumn("place", F.row_number().over(W.partitionBy("symbol", "segment").orderBy("month")) - 1)


def ticker_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """symbol, turnover, trades of a stored 24-hour ticker list (a JSON array of objects, or one a line)."""
    raw = spark.read.schema("symbol string, quoteVolume string, count long").option("multiLine", False).json(path)
    return raw.select("symbol", F.col("quoteVolume").cast("double").alias("turnover"), F.col("count").alias("trades")).where("symbol is not null")


def ledger_text(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a ledger import as a map header -> text: `csv`, or `zip_csv` with exactly one CSV of 128 MB at most."""
    if kind not in ("csv", "zip_csv"):
        raise ValueError("unsupported_ledger_format")
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if kind == "csv":
                    files = [io.BytesIO(content)]
                else:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    members = [m for m in archive.infolist() if not m.is_dir()]
                    if len(members) != 1 or not members[0].filename.endswith(".csv") or members[0].file_size > MOST_BYTES:
                        raise ValueError("archive_must_hold_one_csv")
                    files = [archive.open(members[0])]
                for f in files:
                    for part in pd.read_csv(f, dtype=str, chunksize=50_000, keep_default_na=False):
                        yield pd.DataFrame({"path": name, "line": part.index.to_numpy("int64"), "fields": part.to_dict("records")})

    return raw.mapInPandas(run, "path string, line long, fields map<string,string>")


def account_pages(spark: SparkSession, path: str, schema: str, pages_at_once: int = 100) -> DataFrame:
    """Account pages that a client stored as NDJSON files, as a stream: the checkpoint of the query that reads it is
    the resumable cursor, and a page that comes twice is one file name and read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", pages_at_once).json(path)


def month_catalogue(paths: DataFrame) -> DataFrame:
    """symbol, segment, month (months since year 0) of paths like SYMBOL-segment-2024-03.zip."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda i: F.regexp_extract(name, r"^([A-Z0-9_]+)-([A-Za-z0-9]+)-(\d{4})-(\d{2})\.zip$", i)
    return paths.where(part(1) != "").select("path", part(1).alias("symbol"), part(2).alias("segment"), (part(3).cast("int") * 12 + part(4).cast("int") - 1).alias("month"))


def month_plan(start: Column, end: Column, most: int = 120) -> Column:
    """First days of the months that [start, end) touches; more than `most` fail the job."""
    last = end - F.expr("interval 1 microsecond")
    months = F.sequence(F.trunc(start.cast("date"), "month"), F.trunc(last.cast("date"), "month"), F.expr("interval 1 month"))
    return F.when(F.size(months) > most, F.raise_error(F.lit("too_many_months")).cast("array<date>")).otherwise(months)


def mapped_csv(spark: SparkSession, path: str, columns: dict[str, str], constants: dict[str, str], timestamp_format: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with code) of a CSV with an explicit map field -> header and constants.
    timestamp_format: iso8601, unix_ms or utc_datetime for the field traded_at."""
    unknown = set(columns) & set(constants)
    if unknown or not set(required) <= set(columns) | set(constants):
        raise ValueError("invalid_column_map")
    raw = spark.read.option("header", True).csv(path)
    if missing := set(columns.values()) - set(raw.columns):
        raise ValueError(f"missing_column: {sorted(missing)}")
    rows = raw.select(*[F.col(f"`{h}`").alias(f) for f, h in columns.items()], *[F.lit(v).alias(f) for f, v in constants.items()])
    if "traded_at" in rows.columns:
        t = F.col("traded_at")
        at = {"iso8601": lambda: F.to_timestamp(F.try_to_timestamp(t)), "unix_ms": lambda: F.timestamp_millis(t.try_cast("long")), "utc_datetime": lambda: F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))}[timestamp_format]()
        rows = rows.withColumn("traded_at", at)
    code = F.lit(None).cast("string")
    for f in reversed(required):
        code = F.when(F.col(f).isNull(), F.lit(f"invalid_{f}")).otherwise(code)
    checked = rows.withColumn("code", code)
    return checked.where("code is null").drop("code"), checked.where("code is not null")


def export(df: DataFrame, path: str, rows_in_file: int = 20_000) -> DataFrame:
    """Writes NDJSON files and returns their manifest: file, rows, sha256."""
    df.write.option("maxRecordsPerFile", rows_in_file).json(path)
    return manifest(df.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), lines.alias("rows"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, added or changed against a manifest."""
    now = manifest(spark, path).select("file", F.col("sha256").alias("now"))
    both = expected.select("file", "sha256").join(now, "file", "full_outer")
    return both.where(~F.col("sha256").eqNullSafe(F.col("now"))).select("file")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows in any order."""
    def digest(df):
        hashed = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("h"))
        return hashed.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()

    return digest(a) == digest(b)


def cached(stored: DataFrame, fresh: DataFrame, keys: list[str], now: Column, hours: int = 24) -> DataFrame:
    """A keyed cache after an upsert: fresh rows replace stored ones and expire after `hours`; what has
    expired is left out."""
    new = fresh.withColumn("expires_at", now + F.make_dt_interval(F.lit(0), F.lit(hours)))
    kept = stored.join(fresh.select(*keys), keys, "left_anti").where(F.col("expires_at") > now)
    return kept.unionByName(new.select(*kept.columns))


def svg_chart(bars: DataFrame, key: str = "symbol", width: int = 640, height: int = 320) -> DataFrame:
    """An SVG of wicks and bodies of each key's bars; keys with gaps are refused."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        if (pdf["end"].to_numpy()[:-1] != pdf["start"].to_numpy()[1:]).any():
            return pd.DataFrame({key: [pdf[key].iloc[0]], "svg": [None]})
        low, high = pdf["low"].min(), pdf["high"].max()
        y = lambda v: round(height - (v - low) / max(high - low, 1e-12) * height, 2)
        step = width / len(pdf)
        marks = []
        for i, r in enumerate(pdf.itertuples()):
            x = round((i + 0.5) * step, 2)
            colour = "green" if r.close >= r.open else "red"
            top, size = y(max(r.open, r.close)), max(abs(y(r.open) - y(r.close)), 1)
            marks.append(f'<line x1="{x}" x2="{x}" y1="{y(r.high)}" y2="{y(r.low)}" stroke="{colour}"/><rect x="{round(x - step * 0.35, 2)}" y="{top}" width="{round(step * 0.7, 2)}" height="{size}" fill="{colour}"/>')
        body = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(marks)}</svg>'
        return pd.DataFrame({key: [pdf[key].iloc[0]], "svg": [body]})

    return bars.groupBy(key).applyInPandas(run, f"{key} string, svg string")


def _png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of height x width x 3 bytes."""
    height, width, _ = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)], axis=1).tobytes()
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def raster_chart(bars: DataFrame, key: str = "symbol", width: int = 640, height: int = 320) -> DataFrame:
    """A PNG of wicks and bodies of each key's bars, as input of an image encoder."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        low, high = pdf["low"].min(), pdf["high"].max()
        y = lambda v: int(round((height - 1) * (1 - (v - low) / max(high - low, 1e-12))))
        canvas, step = np.full((height, width, 3), 255, np.uint8), width / len(pdf)
        for i, r in enumerate(pdf.itertuples()):
            colour = (0, 128, 0) if r.close >= r.open else (200, 0, 0)
            x, left, right = int((i + 0.5) * step), int((i + 0.15) * step), max(int((i + 0.85) * step), int((i + 0.15) * step) + 1)
            canvas[y(r.high) : y(r.low) + 1, x] = colour
            canvas[y(max(r.open, r.close)) : y(min(r.open, r.close)) + 1, left:right] = colour
        return pd.DataFrame({key: [pdf[key].iloc[0]], "png": [_png(canvas)]})

    return bars.groupBy(key).applyInPandas(run, f"{key} string, png binary")


def images(spark: SparkSession, paths: str, most_bytes: int = 32 << 20) -> DataFrame:
    """Image files with their bytes; larger ones are left to the caller's error report."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))
