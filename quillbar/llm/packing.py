"""Operator 5: best-two-fit packing of token sequences.

Method: a sequence is filled greedily, longest piece that fits first; then its smallest piece gives
way to two unpacked pieces if together they fill the enlarged gap more tightly. Pieces of one length
are interchangeable, so the driver packs the histogram of lengths (at most `longest` numbers, whatever
the input) and finds which mixes of lengths to use how often; each piece then looks up its place by
its rank among the pieces of its length. Ranks come from counts by (bucket, length) and their running
sums, so a length that a third of all pieces share is still numbered by many tasks.

Cases: a null text counts as empty and becomes one piece of the end id alone; only documents over
`longest` ids are cut; repeated rows are packed as separate pieces; an empty table gives no rows; other
columns are dropped first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillbar.llm.bpe import WordBPE, loaded, then_unload
from quillbar.llm.common import materialize, slices, table

TOKENIZER = "word_bpe_49k.json"
LONGEST = 4096
END_ID = 1
#: Pieces in a bucket, within which ranks are numbered by one task.
BUCKET = 4096


def pieces(df: DataFrame, tokenizer: bytes, longest: int = LONGEST, end_id: int = END_ID, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """key, piece, start, length, ids_crc32 and (if kept) ids, little-endian unsigned 32-bit."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary file: under 2 MB
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe = loaded(WordBPE, shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts, 4 << 20):
                ids, count = bpe.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                ends = np.cumsum(count)
                raw = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
                count = count + 1
                begin = np.cumsum(count) - count
                each = -(-count // longest)
                row = np.repeat(np.arange(hi - lo), each)
                number = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                start = number * longest
                length = np.minimum(count[row] - start, longest)
                at = (begin[row] + start) * 4
                parts = [raw[a:b] for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                columns = [keys.slice(lo, hi - lo).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["key", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(then_unload(run), schema).withColumnRenamed("key", key)


def best_two_fit(counts: np.ndarray, longest: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """counts[n]: pieces of length n. [(times, [(length, uses), ...])]: mixes and how often each is used."""
    left, out = counts.astype(np.int64).copy(), []
    lengths = np.arange(longest + 1)
    while left.any():
        free = left.copy()
        below = np.maximum.accumulate(np.where(free > 0, lengths, 0))  # the largest free length up to n
        mix: dict[int, int] = {}
        gap = longest
        while gap and (n := int(below[gap])):
            uses = int(min(free[n], gap // n))
            mix[n], gap = mix.get(n, 0) + uses, gap - uses * n
            free[n] -= uses
            if not free[n]:
                below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
        while gap and len(mix):
            small = min(mix)
            room = gap + small
            a = lengths[1 : room + 1][free[1 : room + 1] > 0]
            if not len(a):
                break
            alone = a[free[a] < 2]
            b = below[np.minimum(room - a, a)]
            b = np.where((b == a) & np.isin(a, alone), below[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            best = int(both.argmax())
            if both[best] <= small:
                break
            mix[small] -= 1
            free[small] += 1
            if not mix[small]:
                del mix[small]
            for n in (int(a[best]), int(b[best])):
                mix[n] = mix.get(n, 0) + 1
                free[n] -= 1
            gap = room - int(both[best])
            below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
        times = min(int(left[n]) // uses for n, uses in mix.items())
        out.append((times, sorted(mix.items(), reverse=True)))
        for n, uses in mix.items():
            left[n] -= times * uses
    return out


def _places(mixes, longest: int):
    """Arrays sorted by (length, first rank): key, uses, first sequence, offset."""
    taken, rows, sequence = np.zeros(longest + 1, np.int64), [], 0
    for times, mix in mixes:
        offset = 0
        for n, uses in mix:
            rows.append((n, taken[n], uses, sequence, offset))
            taken[n] += times * uses
            offset += n * uses
        sequence += times
    found = np.array(rows, np.int64).reshape(-1, 5)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return (found[:, 0] << 44) + found[:, 1], found[:, 1], found[:, 2], found[:, 3], found[:, 4]


def pack(found: DataFrame, longest: int = LONGEST, at: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """found (length, ...) with sequence_id and offset. at: columns that tell its rows apart and order them.
    Read twice: give it materialized."""
    spark = found.sparkSession
    histogram = np.zeros(longest + 1, np.int64)
    for row in found.groupBy("length").count().collect():  # one row for each length, `longest` at most
        histogram[row["length"]] = row["count"]
    shared = spark.sparkContext.broadcast(_places(best_two_fit(histogram, longest), longest))
    buckets = max(1, -(-int(histogram.sum()) // BUCKET))
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64(*at), F.lit(buckets)).cast("int"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = W.partitionBy("_bucket", "length").orderBy(*at)
    ranked = dealt.withColumn("_within", F.row_number().over(within)).join(base.drop("_n"), ["_bucket", "length"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, uses, sequence, offset = shared.value
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, (n << 44) + r, "right") - 1
        ahead = r - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + ahead // uses[at], "offset": offset[at] + (ahead % uses[at]) * n})

    placed = ranked.withColumn("_place", place(F.col("length"), F.col("_base") + F.col("_within") - 1))
    kept = [F.col(f"`{c}`") for c in found.columns]
    return placed.select(*kept, "_place.sequence_id", "_place.offset")


def tokenizer_file(name: str = TOKENIZER) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def packed_documents(docs: DataFrame) -> DataFrame:
    found = pieces(docs.select("doc_id", "text"), tokenizer_file(), keep_ids=False)
    # Numbers that are written with the pieces spread them evenly, even those of one repeated document.
    found = materialize(found.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    return pack(found, at=("_at",)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5}
ORACLES: dict[str, str] = {}
