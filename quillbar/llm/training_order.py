"""Operator 3: materialisation of token sequences in training order.

Method: documents become sequences of at most LENGTH ids. A sequence's index is its number within its
scan partition above that partition's base; bases come from an upper bound on the number of sequences by
text length, so texts are tokenized once only. A keyed Feistel network over the next power of four, with
cycle-walking, permutes the index domain: a sequence's slot. Ranges of slots are shards and partitions of
the shuffle; one task sorts a shard by slot and writes it as a file of fixed-stride records. Slots that no sequence has (the bound was
not met) are left out of the file, so record i of a shard is its i-th sequence, and the manifest's counts
give every sequence its global position. A reader resumes at any (shard, record) by one multiplication.

The scan must be repeatable (a table), as Spark's own recovery assumes; files appear by rename, so a task
that is run again replaces nothing half-written.

Shards go to any file system that pyarrow opens (local, HDFS, object stores); a path without a scheme is
of Spark's default file system, and one that pyarrow does not open is refused before any work is done.

Record, little-endian: document id (int64), piece (int32), number of ids (uint16), flags (uint16, 1: no
document id), LENGTH ids (uint16).

Cases: a null text counts as empty and becomes one sequence of the end id alone; a null key is null again
when read; repeated rows are separate sequences; an empty table writes no shard; other columns are dropped
first.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.llm.bpe import WordBPE, loaded, then_unload
from quillbar.llm.common import shared_path, slices, table
from quillbar.llm.words import mix

LENGTH = 512
END_ID = 1
KEY = 20_240_101
ROUNDS = 6
#: Bytes of text for each shard.
TEXT_IN_SHARD = 48_000_000
#: Ids that a byte of text can become: composition and lower case can lengthen a text.
IDS_PER_BYTE = 4
RECORD = np.dtype([("doc", "<i8"), ("piece", "<i4"), ("n", "<u2"), ("flags", "<u2"), ("ids", "<u2", (LENGTH,))])
NO_KEY = 1


class Feistel:
    """A permutation of range(size) that depends on a key."""

    def __init__(self, size: int, key: int = KEY, rounds: int = ROUNDS):
        self.size, self.half = max(1, size), max(1, -(-(max(2, size) - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _walk(self, x, keys, back):
        out = np.asarray(x).astype(np.uint64)
        live = np.arange(len(out))
        h = np.uint64(self.half)
        while len(live):
            left, right = out[live] >> h, out[live] & self.mask
            for k in keys:
                if back:
                    left, right = right ^ (mix(left + k) & self.mask), left
                else:
                    left, right = right, left ^ (mix(right + k) & self.mask)
            out[live] = (left << h) | right
            live = live[out[live] >= np.uint64(self.size)]  # walk on until inside the domain
        return out.astype(np.int64)

    def forward(self, x):
        return self._walk(x, self.keys, False)

    def back(self, x):
        return self._walk(x, self.keys[::-1], True)


def sequences(docs: DataFrame, tokenizer: bytes, bases: dict[int, int], size: int, key: str = "doc_id", text: str = "text", seed: int = KEY) -> DataFrame:
    """slot, doc, piece, ids (binary, uint16) of every sequence."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, bases))  # a vocabulary and a number a partition

    def run(batches):
        bpe, order = loaded(WordBPE, shared.value[0]), Feistel(size, seed)
        partition = TaskContext.get().partitionId()
        at, limit = shared.value[1].get(partition, 0), shared.value[1].get(partition + 1, size)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts, 4 << 20):
                ids, count = bpe.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                raw = memoryview(np.insert(ids, np.cumsum(count), END_ID).astype("<u2").tobytes())
                count = count + 1
                each = -(-count // LENGTH)
                row = np.repeat(np.arange(hi - lo), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                begin = (np.cumsum(count) - count)[row] + piece * LENGTH
                end = np.minimum(begin + LENGTH, np.cumsum(count)[row])
                if at + len(row) > limit:
                    raise RuntimeError("a scan partition has more sequences than were planned for it")
                slot = order.forward(np.arange(at, at + len(row)))
                at += len(row)
                parts = [raw[2 * a : 2 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(slot), keys.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(parts, pa.binary())], ["slot", "doc", "piece", "ids"])

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(then_unload(run), "slot long, doc long, piece int, ids binary")


def plan(docs: DataFrame, text: str = "text") -> tuple[dict[int, int], int, int]:
    """(first index of each scan partition, size of the index domain, bytes of text)."""
    most = F.ceil((F.coalesce(F.octet_length(text), F.lit(0)) * IDS_PER_BYTE + 1) / LENGTH)
    sized = docs.select(F.spark_partition_id().alias("p"), most.alias("most"), F.octet_length(text).alias("bytes"))
    rows = sized.groupBy("p").agg(F.sum("most").alias("most"), F.sum("bytes").alias("bytes")).collect()  # a row a partition
    known, bases, total = {r["p"]: r["most"] for r in rows}, {}, 0
    for p in range(max(known, default=-1) + 1):
        bases[p] = total
        total += known.get(p, 0)
    return bases, total, sum(r["bytes"] or 0 for r in rows)


def store_uri(spark, path: str) -> str:
    """path with its scheme, as Spark would complete it; fails if pyarrow cannot open its file system."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(hadoop).toString()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file:///") else uri
    pa.fs.FileSystem.from_uri(uri)
    return uri


def _records(batch: pa.RecordBatch) -> np.ndarray:
    """Batch of (shard, doc, piece, ids) -> fixed-stride records."""
    records = np.zeros(batch.num_rows, RECORD)
    doc, ids = batch.column(1), batch.column(3)
    records["doc"], records["piece"] = doc.fill_null(0).to_numpy(), batch.column(2).to_numpy()
    records["flags"] = np.where(doc.is_null().to_numpy(zero_copy_only=False), NO_KEY, 0)
    records["n"] = n = pa.compute.binary_length(ids).to_numpy(zero_copy_only=False) // 2
    row = np.repeat(np.arange(len(n)), n)
    records["ids"][row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.frombuffer(b"".join(ids.to_pylist()), "<u2")
    return records


def write_shards(docs: DataFrame, tokenizer: bytes, path: str, key: str = "doc_id", text: str = "text", seed: int = KEY) -> DataFrame:
    """Writes shard files below path and returns the manifest: shard, file, sequences, crc32."""
    spark = docs.sparkSession
    path, narrow = store_uri(spark, path), docs.select(key, text)
    bases, size, length = plan(narrow, text)
    shards = max(1, min(-(-length // TEXT_IN_SHARD), max(1, size)))
    found = sequences(narrow, tokenizer, bases, size, key, text, seed)
    dealt = found.withColumn("shard", F.floor(F.col("slot") / F.lit(max(1, -(-size // shards)))).cast("int"))

    def run(batches):
        store, folder = pa.fs.FileSystem.from_uri(path)
        task = TaskContext.get().taskAttemptId()
        now, out, held, crc, name = None, None, 0, 0, ""

        def close():
            out.close()
            store.move(f"{folder}/.{name}-{task}", f"{folder}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), pa.array([held], pa.int64()), pa.array([crc], pa.int64())], ["shard", "file", "sequences", "crc32"])

        for batch in batches:
            shard, records = batch.column(0).to_numpy(), _records(batch)
            edges = np.flatnonzero(np.diff(shard, prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(shard)], strict=True):
                if shard[lo] != now:
                    if out is not None:
                        yield close()
                    now, held, crc = int(shard[lo]), 0, 0
                    name = f"shard-{now:06d}.bin"
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/.{name}-{task}")
                raw = records[lo:hi].tobytes()
                out.write(raw)
                held, crc = held + hi - lo, zlib.crc32(raw, crc)
        if out is not None:
            yield close()

    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "slot").select("shard", "doc", "piece", "ids")
    manifest = ordered.mapInArrow(then_unload(run), "shard int, file string, sequences long, crc32 long")
    rows = sorted(manifest.collect())  # a row a shard
    return spark.createDataFrame(rows, "shard int, file string, sequences long, crc32 long")


def read_shards(manifest: DataFrame, path: str, start: int = 0) -> DataFrame:
    """position, doc, piece, n, ids of the sequences from global position `start` on, read in order
    within each shard; nothing before `start` is read."""
    rows = sorted(manifest.select("shard", "file", "sequences").collect())
    before, plan_rows = 0, []
    for shard, file, n in rows:
        if before + n > start:
            plan_rows.append((shard, file, before, max(0, start - before), n))
        before += n
    spark, path = manifest.sparkSession, store_uri(manifest.sparkSession, path)
    parts = spark.createDataFrame(plan_rows, "shard int, file string, base long, skip long, n long").repartition(max(1, len(plan_rows)), "shard")

    def run(batches):
        store, folder = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{folder}/{row['file']}") as f:
                    f.seek(row["skip"] * RECORD.itemsize)
                    at = row["base"] + row["skip"]
                    while raw := f.read(4096 * RECORD.itemsize):
                        records = np.frombuffer(raw, RECORD)
                        ids = [x[:n].tobytes() for x, n in zip(records["ids"], records["n"].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(records))), pa.array(records["doc"].astype(np.int64), mask=records["flags"] == NO_KEY), pa.array(records["piece"].astype(np.int32)), pa.array(records["n"].astype(np.int32)), pa.array(ids, pa.binary())], ["position", "doc", "piece", "n", "ids"])
                        at += len(records)

    return parts.mapInArrow(then_unload(run), "position long, doc long, piece int, n int, ids binary")


def op3(spark, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        tokenizer = f.read()
    path = shared_path(spark, "shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), tokenizer, path)
    found = read_shards(manifest, path)
    return found.select("position", F.col("doc").alias("doc_id"), "piece", F.col("n").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op3_training_order": op3}
ORACLES: dict[str, str] = {}
