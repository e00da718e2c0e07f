"""An index of chart windows that is built block by block and reuses what has not changed.

Bars are dealt to blocks of time. A window belongs to the block in which it starts and may need bars of later ones, so a block is named by a
hash of its bars and of those within a window's length after it. A build writes the blocks whose name is new, takes over the others,
and commits by a manifest of its own that says which name each block has; what it covers is given as ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbar.operators.bars import merged
from quillbar.operators.ordered import micros, moment
from quillbar.operators.shapes import POINTS, normalize_all
from quillbar.session import written

#: Bars of a block.
BLOCK = 512
MANIFEST = "symbol string, block long, name string, generation long"


def descriptors(ohlc: np.ndarray, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, descriptors) of the windows that begin at `starts` and have a shape: shapes.descriptor of many."""
    found, p = normalize_all(ohlc, size)
    kept = np.isin(found, starts)
    found, p = found[kept], p[kept]
    centre = (p[:, :, 0] + p[:, :, 3]) / 2
    step = np.diff(centre, axis=1, prepend=centre[:, :1])
    flat = np.stack([centre - 0.5, (p[:, :, 1] - p[:, :, 2]) / 2, step * 2], 2).reshape(len(p), 3 * POINTS).astype(np.float32)
    length = np.sqrt((flat * flat).sum(1, dtype=np.float32))
    able = length > 1e-6
    return found[able], flat[able] / length[able, None]


def _dealt(bars: DataFrame, size: int, seconds: int) -> DataFrame:
    """Bars numbered on their grid, each in the block where it starts and in those whose last windows reach it."""
    number = F.floor(micros(F.col("start")) / (seconds * 1_000_000))
    known = bars.where("start is not null").select(F.col("symbol").cast("string").alias("symbol"), number.alias("number"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])
    first = F.floor((F.col("number") - size + 1) / BLOCK)
    return known.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("number") / BLOCK))))


def build(bars: DataFrame, path: str, size: int, stride: int, seconds: int) -> dict:
    """A generation of the index over bars (symbol, start, open, high, low, close; `seconds` long each), windows starting at grid numbers that
    stride divides. Gives its number, and how many blocks were built and taken over."""
    spark = bars.sparkSession
    dealt = written(_dealt(bars, size, seconds), "dealt")
    content = F.xxhash64("number", "open", "high", "low", "close")
    # The order of bars is in their numbers: sums of two hashes name the set of them.
    name = F.concat_ws("-", F.lit(f"{size}-{stride}-{seconds}"), F.hex(F.bit_xor(content)), F.hex(F.sum(content.bitwiseAND((1 << 40) - 1))), F.count(F.lit(1)))
    named = dealt.groupBy("symbol", "block").agg(name.alias("name"), F.max("number").alias("last")).where(F.col("last") >= F.col("block") * BLOCK).drop("last")
    before = manifest(spark, path)
    generation = 1 + (before.agg(F.coalesce(F.max("generation"), F.lit(0)).alias("g")).first()["g"])
    known = before.select("symbol", "block", "name").distinct()
    fresh = written(named.join(known, ["symbol", "block", "name"], "left_anti"), "fresh")

    def windows(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("number", keep="last").sort_values("number")
        number, block, out = pdf["number"].to_numpy(np.int64), int(key[1]), []
        ohlc = pdf[["open", "high", "low", "close"]].to_numpy(np.float64)
        whole = np.flatnonzero((number // BLOCK == block) & (number % stride == 0))
        whole = whole[whole + size <= len(number)]
        whole = whole[number[whole + size - 1] - number[whole] == size - 1]  # no holes
        found, vectors = descriptors(ohlc, size, whole)
        out = [(key[0], block, key[2], int(number[i]), v.tolist()) for i, v in zip(found, vectors, strict=True)]
        return pd.DataFrame(out, columns=["symbol", "block", "name", "number", "embedding"])

    # Only the bars of new blocks are read again.
    rows = dealt.join(fresh, ["symbol", "block"])
    made = rows.groupBy("symbol", "block", "name").applyInPandas(windows, "symbol string, block long, name string, number long, embedding array<float>")
    made.write.mode("overwrite").parquet(f"{path}/windows/generation={generation}")
    named.withColumn("generation", F.lit(generation).cast("long")).write.mode("overwrite").parquet(f"{path}/manifests/{generation}")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    built = count(fresh)
    return {"generation": generation, "built": built, "reused": count(named) - built}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """symbol, block, name, generation of all builds that have ended."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/manifests")


def windows(spark: SparkSession, path: str, size: int, seconds: int, generation: int | None = None) -> DataFrame:
    """symbol, start, end, embedding of a generation, the latest if none is named: its own blocks and those taken over. Windows that a build
    wrote and did not commit are not there."""
    every = manifest(spark, path)
    if generation is None:
        generation = every.agg(F.max("generation").alias("g")).first()["g"] or 0
    now = every.where(F.col("generation") == generation).select("symbol", "block", "name")
    # The build that wrote a block is the first that names it.
    first = every.where(F.col("generation") <= generation).groupBy("symbol", "block", "name").agg(F.min("generation").alias("generation")).join(now, ["symbol", "block", "name"])
    schema = "symbol string, block long, name string, number long, embedding array<float>, generation long"
    found = spark.read.schema(schema).parquet(f"{path}/windows").join(first, ["symbol", "block", "name", "generation"], "left_semi")
    at = lambda n: moment(n * seconds * 1_000_000)
    return found.select("symbol", at(F.col("number")).alias("start"), at(F.col("number") + size).alias("end"), "embedding")


def coverage(found: DataFrame) -> DataFrame:
    """symbol, start, end: the ranges that windows cover."""
    return merged(found.select("symbol", "start", "end"), ["symbol"])
