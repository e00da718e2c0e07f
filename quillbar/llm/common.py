"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbar.session import table

__all__ = ["table", "shared_dir", "materialize", "slices", "bounded_count", "framed"]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset and the master
    is local, as in tests) a new temporary folder that is then set for this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("quillbar.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillbar-")
        spark.conf.set("quillbar.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/quillbar/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and returns a reader of it. Lost
    executors lose nothing of it, and later plans read it instead of computing it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(column: pa.Array | pa.ChunkedArray, most_bytes: int, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary column holding about most_bytes each (one row at least)."""
    lo = size = 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        if i > lo and (size + (n or 0) > most_bytes or i - lo >= most_rows):
            yield lo, i
            lo, size = i, 0
        size += n or 0
    if len(column) > lo:
        yield lo, len(column)


def bounded_count(df: DataFrame) -> int:
    """Row count as one aggregated row."""
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def framed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(rows, apart). rows: whole (a struct of all columns of docs, whatever their names), doc (key as long), text, row: a long
    that orders rows as key does and differs where texts do. It is the key itself, or a number where some
    key has several texts (then apart is true); null where the key is null. select("whole.*") gives docs."""
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    named = docs.select(columns, F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = named.where("doc is not null").select("doc", F.xxhash64("text").alias("h")).distinct()
    if not ids.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return named.withColumn("row", F.col("doc")), False
    numbered = materialize(ids.orderBy("doc", "h").withColumn("row", F.monotonically_increasing_id()), "rows")
    return named.withColumn("h", F.xxhash64("text")).join(numbered, ["doc", "h"], "left").drop("h"), True
