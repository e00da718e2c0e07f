"""Operator 10: byte-level BPE encoding and decoding.

Method: the pieces that the split pattern finds become rows of length-bucketed padded matrices; each
round every row merges its leftmost pair of least rank (hashed pair lookup) and the matrix closes up.
Distinct pieces are merged once and remembered by the worker within a bound. The plan is one scan and
two map stages without a shuffle, so a lost executor costs the partitions it held and nothing more.

Cases: a null text is encoded as the empty text (no ids); an empty table gives an empty result;
repeated rows give repeated results; a null id is carried; columns other than the two named are
dropped first, so their names cannot clash; a text of over 2^29 ids fails the job with a clear message,
because its ids would not fit a row of any table.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.llm.bpe import ByteBPE, TokenBytes, loaded
from quillbar.llm.common import slices, table

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20


def encode(df: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (binary: little-endian unsigned 32-bit ids) of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: under 1 MB
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe = loaded(ByteBPE, shared.value, pattern)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(texts, TOGETHER):
                ids, count = bpe.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                ends = np.concatenate([[0], np.cumsum(count)]) * 4
                if ends[-1] >= 1 << 31:  # one text alone: several are at most TOGETHER bytes
                    raise ValueError("a text has more ids than a row can hold")
                ends = ends.astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count), packed], ["key", "n_tokens", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; an id without a token fails the job."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(ids)

    def run(batches):
        tokens = loaded(TokenBytes, shared.value)
        for batch in batches:
            for lo, hi in slices(batch.column(at), 2 * TOGETHER):
                part = batch.slice(lo, hi - lo)
                raw = [x or b"" for x in part.column(at).to_pylist()]
                count = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                text, size = tokens.decode(np.frombuffer(b"".join(raw), "<u4").astype(np.int64))
                each = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])].astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(each), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([*part.columns, packed], [*part.schema.names, out])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, `{out}` binary")


def ranks_file(name: str = RANKS) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op10(spark, sf_dir: str) -> DataFrame:
    ranks, pattern = ranks_file(), public_tokenizers.PATTERN
    found = decode(encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_byte_bpe": op10}
ORACLES: dict[str, str] = {}
