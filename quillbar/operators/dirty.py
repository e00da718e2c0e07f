"""A log of changed sources and the index that follows it.

Sources append (source_id, revision) to the log when they change. A run claims the latest revision of each source in its batch, builds
their documents and commits by writing the claims to the done log last; run again under the same number, it overwrites what it wrote.
A claim is settled only up to its own revision, so a change during the build stays dirty and is the next run's. Documents of dirty sources, and those of runs
that did not end, are hidden.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbar.session import written

LOG = "source_id long, revision long"


def mark(changes: DataFrame, path: str) -> None:
    """Appends changes (source_id, revision) to the log."""
    changes.select("source_id", "revision").write.mode("append").parquet(f"{path}/log")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def log(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}/log", LOG)


def settled(spark: SparkSession, path: str) -> DataFrame:
    """source_id, done: the latest revision that a run has committed."""
    return _table(spark, f"{path}/done", f"{LOG}, batch long").groupBy("source_id").agg(F.max("revision").alias("done"))


def dirty(spark: SparkSession, path: str) -> DataFrame:
    """source_id, revision: the latest change of each source that no run has settled."""
    latest = log(spark, path).groupBy("source_id").agg(F.max("revision").alias("revision"))
    return latest.join(settled(spark, path), "source_id", "left").where(F.col("done").isNull() | (F.col("revision") > F.col("done"))).drop("done")


def run(batch: DataFrame, number: int, path: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """One run over a batch of the log. build(claims): documents with source_id and revision of the claimed sources as they are now; a
    source that is gone has none."""
    claims = written(batch.groupBy("source_id").agg(F.max("revision").alias("revision")), "claims")
    build(claims).write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
    claims.select("source_id", "revision").write.mode("overwrite").parquet(f"{path}/done/batch={number}")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that may be shown: those of the last committed revision of sources that are not dirty."""
    commits = _table(spark, f"{path}/done", f"{LOG}, batch long")
    last = commits.groupBy("source_id").agg(F.max(F.struct("revision", "batch")).alias("c")).select("source_id", "c.revision", "c.batch")
    found = _table(spark, f"{path}/documents", f"{schema}, batch long").join(last, ["source_id", "revision", "batch"], "left_semi")
    return found.join(dirty(spark, path).select("source_id"), "source_id", "left_anti").drop("batch")


def follow(spark: SparkSession, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]):
    """Runs over what the log has gained since the checkpoint; the number of a micro-batch is the number of its run."""
    stream = spark.readStream.schema(LOG).parquet(f"{path}/log")
    return stream.writeStream.foreachBatch(lambda b, n: run(b, n, path, build)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
