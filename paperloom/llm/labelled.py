"""What the classifiers share: a bounded sample of labelled rows, a column added to whole rows, small fits in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paperloom.llm.words import batch_of, slices, split_words, texts
from paperloom.session import checkpointed


def signatures(col: pa.Array) -> np.ndarray:
    """Smallest hash of the three-word runs of each text; copies and most near copies share it. Without such a run: zero."""
    codes, offsets, words = split_words(col)
    out = np.zeros(len(col), dtype=np.int64)
    if len(codes) < 3:
        return out
    h = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], dtype=np.uint64)[codes]
    run = h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:-1] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h[2:] + np.uint64(7)) * np.uint64(0x165667B19E3779F9)
    run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    some = np.flatnonzero(np.diff(offsets) > 2)
    owner = np.repeat(np.arange(len(col)), np.diff(offsets))
    run[owner[:-2] != owner[2:]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if len(some):
        out[some] = np.minimum.reduceat(run, offsets[:-1][some]).view(np.int64)
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text, label`` of at most ``rows`` usable labelled keys, those with the smallest hashes.

    The sample of keys is bounded by the parameter and therefore broadcast; texts are not shuffled. Labels other than 0 and 1
    and null keys are left out; a key labelled twice keeps its larger label. Of texts with one signature (copies and most near
    copies) one stays, else a group of copies would decide what is learned; it is the least by text, whichever task finds it.
    """
    known = labels.where(usable & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__key"), "__key").limit(rows)
    found = docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("__k") == F.col("__key")).select("text", "label")
    schema = pa.schema([("text", pa.string()), ("label", pa.int32()), ("signature", pa.int64())])

    def sign(batches):
        for part in slices(batches):
            col = texts(part)
            yield batch_of(schema, col, part.column(1).cast(pa.int32()), signatures(col))

    signed = found.mapInArrow(sign, "text string, label int, signature long").withColumn("short", F.when(F.col("signature") == 0, F.col("text")))
    return checkpointed(signed.groupBy("signature", "short").agg(F.min(F.struct("text", "label")).alias("one")).select("one.text", "one.label"))


def with_score(docs: DataFrame, name: str, scorer: Callable[[], Callable[[pa.Array], np.ndarray]], text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a column of scores; ``scorer`` is called once in each task. ``name`` must be free: another column of
    that name raises, since nobody could select either. A null text is scored as an empty one; every row stays."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {name} already; give the score another name")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        score = scorer()
        for part in slices(batches, text, size=4 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(texts(part, text)).astype(np.float64))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest, by golden section on its logarithm."""
    def loss(t):
        z = logit / np.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    lo, hi, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
