"""Arrow helpers that the tasks share: bounded slices, words of a batch as codes into its distinct words, rows joined back by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"


def held_out(key: str, folds: int, fold: int) -> Column:
    """Is crc32 of the key as text, modulo ``folds``, equal to ``fold``? A null key counts as not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str = "__row") -> DataFrame:
    """A row number that repeats when the frame is computed again. The frame must come from files, not from a shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column of a batch; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.string()) if col.type != pa.string() else col, "")


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``rows`` rows and about ``size`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + size, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def split_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: codes into the distinct words, offsets of the texts, distinct words."""
    parts = pc.ascii_split_whitespace(col)
    flat = parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    mask = keep.to_numpy(zero_copy_only=False)
    count = np.concatenate(([0], np.cumsum(mask)))
    offsets = count[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    if not mask.all():
        flat = flat.filter(keep)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets.astype(np.int64), coded.dictionary


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate((np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def batch_of(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
