"""Frozen runs of a projection, and pages over them.

A run is a table that never changes: rows numbered in its order, up to an epoch that is closed, and a manifest that is written last, so a run
that did not end is not there. A page's cursor names its run, the filter and the last number; a later run leaves the pages of an earlier one
as they are, and a cursor of another filter is refused. Numbers are ranges of files, so a page reads what holds it.
"""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbar.operators.folds import numbered

MANIFEST = "run string, closed_through long, rows long, filter string, made long"


def digest(filters: dict) -> str:
    """Names a filter, whatever the order of its parts."""
    return hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def freeze(rows: DataFrame, path: str, run: str, order: list, filters: dict, closed_through: int) -> dict:
    """Writes a run: rows, which are those up to closed_through (microseconds) that pass the filter, in an order that tells them apart. A run
    that is there already stays as it is."""
    spark = rows.sparkSession
    known = manifest(spark, path, run)
    if known is not None:
        if (known["filter"], known["closed_through"]) != (digest(filters), closed_through):
            raise ValueError("run_is_frozen")
        return known
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("closed_at"), F.lit(0)).alias("last")).first()
    if count["last"] > closed_through:
        raise ValueError("epoch_not_closed")
    numbered(rows, order, "place").repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").parquet(f"{path}/rows/{run}")
    made = 1 + max((r["made"] for r in _manifests(spark, path).select("made").collect()), default=0)  # a row a run
    found = {"run": run, "closed_through": closed_through, "rows": count["n"], "filter": digest(filters), "made": made}
    spark.createDataFrame([tuple(found.values())], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{run}")
    return found


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/manifests")


def manifest(spark: SparkSession, path: str, run: str | None = None) -> dict | None:
    """The manifest of a run, or of the latest one."""
    found = _manifests(spark, path)
    found = found if run is None else found.where(F.col("run") == run)
    row = found.orderBy(F.desc("made")).limit(1).collect()
    return row[0].asDict() if row else None


def _cursor(run: str, name: str, after: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([run, name, after]).encode()).decode()


def _opened(spark: SparkSession, path: str, filters: dict, cursor: str | None) -> tuple[dict, int]:
    """The manifest of the run that a cursor names, or of the latest run of this filter, and the last number that was read."""
    name = digest(filters)
    if cursor is None:
        latest = _manifests(spark, path).where(F.col("filter") == name).orderBy(F.desc("made")).limit(1).collect()
        if not latest:
            raise ValueError("run_missing")
        run, after = latest[0]["run"], 0
    else:
        try:
            run, of, after = json.loads(base64.urlsafe_b64decode(cursor))
        except (ValueError, TypeError):
            raise ValueError("cursor_invalid") from None
        if of != name:
            raise ValueError("cursor_mismatch")
    known = manifest(spark, path, run)
    if known is None:
        raise ValueError("run_missing")
    return known, after


def page(spark: SparkSession, path: str, filters: dict, size: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """(rows, cursor of the next page or None). Without a cursor: the first page of the latest run of this filter."""
    known, after = _opened(spark, path, filters, cursor)
    rows = spark.read.parquet(f"{path}/rows/{known['run']}").where((F.col("place") > after) & (F.col("place") <= after + size)).orderBy("place")
    return rows, _cursor(known["run"], digest(filters), after + size) if after + size < known["rows"] else None


def pages(spark: SparkSession, path: str, filters: dict, size: int, cursor: str | None = None) -> DataFrame:
    """The rows of every page from a cursor on, as `page` gives them one after the other, with `page`: 0 for the first of them. One scan,
    however many pages there are."""
    known, after = _opened(spark, path, filters, cursor)
    rows = spark.read.parquet(f"{path}/rows/{known['run']}").where(F.col("place") > after)
    return rows.withColumn("page", F.floor((F.col("place") - after - 1) / size).cast("int"))
