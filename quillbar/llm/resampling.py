"""Operator 13: documents drawn by importance towards the texts of a target, by hashed n-gram features.

A text's features are its runs of 1 to `longest` consecutive words; each falls into one of BUCKETS buckets. What a bucket
is worth is the logarithm of its share in the target over its share in all documents, both smoothed; a document's weight
is the sum over its features. Scores add Gumbel noise that depends on the key alone, so the highest scores are a draw without
replacement by weight.

Plan: a text is cut at word boundaries into chunks of CHUNK bytes. A chunk owns the words that start in it and carries the
longest - 1 words that follow, so each feature belongs to the chunk of its first word and is counted once. Texts of one chunk
are read where they are; the chunks of longer ones are written once, dealt evenly, so no task holds a long text's work. Counts
are sums of BUCKETS numbers a task; the gains (BUCKETS numbers) are all that is collected. Weights of chunks are summed by document.
Ranks come from sorted ranges, each numbered apart and shifted by the sizes of those before it.

Cases: null and empty texts have no features and weight 0; each row is a document of its own, also where rows repeat or
share a key; ties go to the smaller key, a null key last; a null key's noise is that of an empty one; a word longer than a chunk is one
chunk; without documents there are no rows, without a target all documents are weighed against nothing (t = T = 0);
other columns are dropped first, so their names never clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.llm.common import materialize, slices, table

BUCKETS, LONGEST, SHARE, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Bytes of text that a chunk owns.
CHUNK = 64 << 10
# Bytes outside words, once A-Z are lower-cased.
_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def chunks(text: bytes, longest: int = LONGEST, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(bytes owned, bytes owned and carried) of each chunk of a lower-cased text."""
    at = 0
    while at < len(text):
        edge = _BETWEEN.search(text, at + size) if at + size < len(text) else None
        end = edge.start() if edge else len(text)
        carried = end
        for _ in range(longest - 1):
            word = _WORD.search(text, carried)
            if not word:
                break
            carried = word.end()
        yield end - at, text[at:carried]
        at = end


def features(owned: int, text: bytes, longest: int = LONGEST) -> tuple[int, Iterator[bytes]]:
    """(words owned, the features that start in the owned part) of a chunk."""
    if longest == 1:
        words = _WORD.findall(text)
        return len(words), iter(words)
    starts = [w.span() for w in _WORD.finditer(text)]
    words = [text[a:b] for a, b in starts]
    own = sum(a < owned for a, _ in starts)
    return own, (b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(min(own, len(words) - k + 1)))


def _buckets(found: Iterator[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), np.int64) % buckets


def _cut(longest: int):
    """Batches of (row, key, text) of long texts -> row, key, owned, chunk."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in slices(texts, 8 << 20):
                for i in range(lo, hi):
                    found = list(chunks(texts[i].as_buffer().to_pybytes().translate(_LOWER), longest))
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(1)[i].as_py()] * n, pa.int64()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["row", "key", "owned", "chunk"])

    return run


def _parts(batch) -> Iterator[tuple[int, int, list[tuple[int, bytes]]]]:
    """Slices of a batch whose last columns are (owned, chunk), or whole texts where owned is null."""
    owned, text = batch.column("owned"), batch.column("chunk")
    for lo, hi in slices(text, 8 << 20):
        size = owned.slice(lo, hi - lo).to_pylist()
        yield lo, hi, [(len(x or b"") if n is None else n, (x or b"").translate(_LOWER)) for n, x in zip(size, text.slice(lo, hi - lo).to_pylist(), strict=True)]


def _counted(longest: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, parts in _parts(batch):
                for owned, text in parts:
                    total += np.bincount(_buckets(features(owned, text, longest)[1], buckets), minlength=buckets)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], ["bucket", "n"])

    return run


def _weighed(longest: int, buckets: int, gains):
    """Adds words, n_features and weight to batches of (row, key, owned, chunk)."""

    def run(batches):
        for batch in batches:
            gain = gains.value
            for lo, hi, parts in _parts(batch):
                out = np.zeros((3, hi - lo), np.int64)
                for i, (owned, text) in enumerate(parts):
                    words, found = features(owned, text, longest)
                    bucket = _buckets(found, buckets)
                    out[:, i] = words, len(bucket), gain[bucket].sum()
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), *map(pa.array, out)], ["row", "key", "words", "n_features", "weight"])

    return run


def in_chunks(docs: DataFrame, key: str | None, text: str, longest: int = LONGEST) -> DataFrame:
    """row, key, owned, chunk: short texts as they are (row and owned null), the chunks of long ones from a written table."""
    named = docs.select((F.col(f"`{key}`") if key else F.lit(None)).cast("long").alias("key"), F.col(f"`{text}`").cast("string").cast("binary").alias("chunk"))
    long = named.where(F.length("chunk") > CHUNK)
    short = named.where(F.coalesce(F.length("chunk") <= CHUNK, F.lit(True)))
    short = short.select(F.lit(None).cast("long").alias("row"), "key", F.lit(None).cast("long").alias("owned"), "chunk")
    dealt = long.select(F.monotonically_increasing_id().alias("row"), "key", "chunk").mapInArrow(_cut(longest), "row long, key long, owned long, chunk binary")
    return short.unionByName(materialize(dealt.repartition(F.xxhash64("row", "chunk")), "chunks"))


def bucket_counts(parts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket."""
    total = np.zeros(buckets, np.int64)
    counted = parts.select("owned", "chunk").mapInArrow(_counted(longest, buckets), "bucket int, n long")
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        total[row["bucket"]] = row["n"]
    return total


def gains(target: np.ndarray, everywhere: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share everywhere)), in doubles."""
    buckets = len(target)
    above = (target + 1).astype(np.float64) * float(int(everywhere.sum()) + buckets)
    below = (everywhere + 1).astype(np.float64) * float(int(target.sum()) + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def ranked(df: DataFrame, drawn: int) -> DataFrame:
    """df (at, eligible, score, key) with rank: places from 1 of the `drawn` first eligible rows, null for the others. Read twice: give
    it written."""
    if not drawn:
        return df.withColumn("rank", F.lit(None).cast("long"))
    placed = materialize(df.where("eligible").select("at", "score", "key").orderBy(F.desc("score"), F.asc_nulls_last("key"), "at").withColumn("id", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("id", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part", before.alias("before")))
    rank = F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1) + 1
    places = placed.select("at", part.alias("part"), "id").join(starts, "part").select("at", rank.alias("rank")).where(F.col("rank") <= drawn)
    return df.join(places, "at", "left")


def noise(seed: int = SEED):
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h from sha256 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """key, n_features, weight, score, rank of every document; `share` percent of those of least_words words have a rank."""
    parts = in_chunks(docs, key, text, longest)
    worth = gains(bucket_counts(in_chunks(target, None, target_text, longest), longest, buckets), bucket_counts(parts, longest, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(worth)  # `buckets` numbers
    weighed = parts.mapInArrow(_weighed(longest, buckets, shared), "row long, key long, words long, n_features long, weight long")
    sums = [F.sum(c).alias(c) for c in ("words", "n_features", "weight")]
    whole = weighed.where("row is null").drop("row").unionByName(weighed.where("row is not null").groupBy("row", "key").agg(*sums).drop("row"))
    scored = whole.withColumn("score", F.col("weight") + noise(seed)).withColumn("eligible", F.col("words") >= least_words)
    scored = materialize(scored.withColumn("at", F.monotonically_increasing_id()), "scores")
    able = scored.where("eligible").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return ranked(scored, able * share // 100).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


def op13(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_importance_resampling": op13}
ORACLES = {
    "op13_importance_resampling": """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS x FROM benchmark),
used AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM texts) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT x FROM (SELECT x FROM used UNION ALL SELECT x FROM target)),
summed AS (
  SELECT x, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(x)), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) % 10000 AS bucket
  FROM vocabulary),
everywhere AS (SELECT bucket, sum(n) AS s FROM used JOIN summed USING (x) GROUP BY bucket),
aimed AS (SELECT bucket, count(*) AS t FROM target JOIN summed USING (x) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM everywhere) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM aimed) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM (SELECT DISTINCT bucket FROM summed) LEFT JOIN everywhere USING (bucket) LEFT JOIN aimed USING (bucket)),
weights AS (SELECT doc_id, sum(n * g) AS weight FROM used JOIN summed USING (x) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (doc_id)),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS "rank"
FROM scored LEFT JOIN places USING (doc_id)
"""
}
