"""Operator 4: language identification with string kernels.

Method: the kernel of two texts counts the byte n-grams (one to three long, blended) present in both,
divided by the geometric mean of their own counts. Nystroem landmarks stand for the training texts, and
one-versus-rest kernel ridge regression gives each language a coefficient for each landmark. Scoring is
a product of batch profiles with landmark profiles, then with the coefficients.

The model is fitted on at most `per_language` labelled texts a language (chosen by a hash of the key);
what reaches the driver is their profiles, `dim` bits each. Everything else is one scan and one map
stage. Labels are taken to be a bounded set of names.

Cases: a null text or one without letters is `und` with score 0, as is every text if nothing is
labelled; null labels are never learned; a null key is never learned and is not held out; repeated rows
are predicted alike; an empty table gives no rows; other columns are dropped first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbar.llm.common import slices, table

DIM = 8192
LANDMARKS = 128
PER_LANGUAGE = 400
RIDGE = 1e-3
UNKNOWN = "und"
#: Rows whose profiles are multiplied together.
ROWS = 256
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint32)
_BITS = DIM.bit_length() - 1


def profile(text: str, row: np.ndarray) -> None:
    """Sets row[h] for the hash h of every n-gram present in the whole text."""
    one = _FOLD[np.frombuffer(text.lower().encode(), np.uint8)]
    two = one[:-1] | (one[1:] << np.uint32(8))
    three = two[:-1] | (one[2:] << np.uint32(16))
    for n, gram in enumerate((one, two, three), 1):
        row[((gram | np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)] = 1


def _kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left @ right.T) / np.sqrt(np.maximum(left.sum(1), 1)[:, None] * np.maximum(right.sum(1), 1)[None, :])


def has_letters(text: str):
    """Whether a text has a letter: the one rule of learning, prediction and the pipeline."""
    return F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def fit(df: DataFrame, held_out, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """held_out: column, true for rows that nothing may be learned from."""
    usable = df.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out & has_letters(text))
    rows = usable.select(F.col(label).cast("string").alias("label"), F.xxhash64(key).alias("h"), F.col(text).cast("string").alias("text"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a language
    if not counts:
        return {"labels": []}
    share = F.element_at(F.create_map(*[F.lit(x) for n, c in sorted(counts.items()) for x in (n, min(1.0, 2.0 * per_language / c))]), F.col("label"))
    few = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)

    def run(batches):
        for batch in batches:
            bits = []
            for t in batch.column(2).to_pylist():
                row = np.zeros(DIM, np.uint8)
                profile(t, row)
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["label", "h", "bits"])

    seen = few.mapInArrow(run, "label string, h long, bits binary")
    first = seen.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("h", "bits"))).where(F.col("n") <= per_language)
    sample = sorted((r["label"], r["h"], bytes(r["bits"])) for r in first.collect())  # per_language rows a language
    names = sorted({x[0] for x in sample})
    grams = np.unpackbits(np.frombuffer(b"".join(x[2] for x in sample), np.uint8).reshape(len(sample), -1), axis=1).astype(np.float32)
    target = np.where(np.array([x[0] for x in sample])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    of = [i for n in names for i in [j for j, x in enumerate(sample) if x[0] == n][: max(1, landmarks // len(names))]]
    points = grams[of]
    across, among = _kernel(grams, points).astype(np.float64), _kernel(points, points).astype(np.float64)
    normal = across.T @ across + ridge * len(sample) * among + 1e-8 * np.eye(len(of))
    weights = np.linalg.solve(normal, across.T @ target)
    return {"labels": names, "points": points, "weights": (weights / np.sqrt(points.sum(1))[:, None]).astype(np.float32)}


def predict(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of every row's whole text."""
    return predicted(df.select(key, text), model, text).select(F.col("whole").getField(key).alias(key), "lang_pred", "score")


def predicted(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """whole (a struct of all columns of df, whatever their names), lang_pred, score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # landmarks x dim floats: 4 MB
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")
    source, at = df.select(whole, has_letters(f"`{text}`").alias("known")), df.columns.index(text)

    def run(batches):
        labels = shared.value["labels"]
        for batch in batches:
            texts, letters = batch.column(0).field(at).cast(pa.string()), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(texts, 2 << 20, ROWS):
                known = letters[lo:hi] & bool(labels)
                names, scores = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                if known.any():
                    grams = np.zeros((int(known.sum()), DIM), np.float32)
                    for row, t in zip(grams, [t for t, k in zip(texts.slice(lo, hi - lo).to_pylist(), known, strict=True) if k], strict=True):
                        profile(t, row)
                    found = (grams @ shared.value["points"].T) @ shared.value["weights"] / np.sqrt(grams.sum(1))[:, None]
                    best = found.argmax(1)
                    names[known] = np.array(labels, object)[best]
                    scores[known] = np.clip((found[np.arange(len(best)), best].astype(np.float64) + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores)], ["whole", "lang_pred", "score"])

    return source.mapInArrow(run, T.StructType([source.schema["whole"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(key: str = "doc_id"):
    """True for keys whose crc32 as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs, held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4}
ORACLES: dict[str, str] = {}
