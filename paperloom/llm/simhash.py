"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.links import components
from paperloom.llm.words import batch_of, free_name, slices, split_words, texts, with_row_id
from paperloom.session import checkpointed

SEED = 42  # of the shingle hash


def fingerprints_of(col: pa.Array, words: int) -> np.ndarray:
    """Fingerprint of each text as signed 64-bit integer: a bit is 1 if it is set in over half the shingle hashes."""
    codes, offsets, distinct = split_words(pc.ascii_lower(col))
    # the words of all texts, a blank after each: a shingle is one slice of it
    size = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), distinct.take(pa.array(codes))), " ")[0].as_py() or ""
    view = memoryview(joined.encode())
    ends = np.cumsum(size[codes] + 1) - 1
    starts = ends - size[codes]
    count = np.diff(offsets)
    shingles = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    out = np.zeros(len(count), dtype=np.int64)
    some = np.flatnonzero(shingles)
    if not len(some):
        return out
    n = shingles[some]
    first = np.repeat(offsets[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.where(np.repeat(count[some], n) >= words, first + words - 1, np.repeat(offsets[some] + count[some] - 1, n))
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(view[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())), dtype=np.uint64, count=len(first))
    ones = np.zeros((len(n), 64), dtype=np.int64)
    cut, at = np.cumsum(n), 0
    step = 1 << 16  # shingles whose bits are spread out at once
    owner = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(h), step):
        bits = np.unpackbits(h[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + step]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    set_ = 2 * ones > n[:, None]
    out[some] = np.packbits(set_, axis=1, bitorder="little").view("<i8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text", row: Column | None = None) -> DataFrame:
    """``doc_id, row, fp`` for each row. A text of fewer words is one shingle, a null or empty one has fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for part in slices(batches, size=4 << 20):
            yield batch_of(schema, part.column(0), part.column(1), fingerprints_of(texts(part), words))

    row = F.lit(0) if row is None else row
    return docs.select(F.col(key).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, row long, fp long")


def popcounts(fp: Column, half: int) -> list[Column]:
    """Bit counts of the sixteen 2-bit segments of one half of a fingerprint."""
    return [F.bit_count(F.shiftright(fp, 32 * half + 2 * s).bitwiseAND(F.lit(3))).cast("long") for s in range(16)]


def cells(fp: Column, half: int) -> Column:
    """The half's bit counts as one number, two bits each: the cell of the grid of width one."""
    total = F.lit(0).cast("long")
    for s, c in enumerate(popcounts(fp, half)):
        total = total + F.shiftleft(c, 2 * s)
    return total + F.lit(half << 40)


def near(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints ``fp`` that differ in at most ``bits`` (up to 3) bits, each once or twice.

    The bit counts of 32 segments embed fingerprints: the Manhattan distance of the counts never exceeds the Hamming
    distance. At 3 differing bits, one half has at most one, so its counts are equal or differ by one in one segment. Each
    fingerprint lies in its own cell of either half's grid and looks into its own cell and the sixteen above; a pair one apart
    is found from the lower side. What meets in a cell is verified exactly inside the join.
    """
    if bits > 3:
        raise ValueError("two halves find pairs of up to 3 differing bits")
    at = distinct.select("fp", F.explode(F.array(cells(F.col("fp"), 0), cells(F.col("fp"), 1))).alias("cell"))
    probes = F.array(F.lit(0).cast("long"), *[F.lit(1 << (2 * s)).cast("long") for s in range(16)])
    # a count is at most two, so a step up from two leaves the grid
    look = at.select("fp", "cell", F.explode(probes).alias("step")).where((F.col("step") == 0) | (F.col("cell").bitwiseAND(F.col("step") * 2) == 0)).select(F.col("fp").alias("a"), (F.col("cell") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("same"))
    pair = look.join(at.withColumnRenamed("fp", "b"), "cell").where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits) & F.when(F.col("same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return pair.select("a", "b")


def groups(docs: DataFrame, words: int = 3, bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for each row: the smallest key that links reach.

    Equal fingerprints fold to one before pairs are sought. Null and repeated keys keep their rows; a component of null keys
    alone has a null id. Texts without words share fingerprint zero and are linked. Other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, words, key, text))
    return rows.join(representatives(rows, bits, F.min("doc_id")), "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def representatives(rows: DataFrame, bits: int, first: Column) -> DataFrame:
    """``fp, first`` for each distinct fingerprint: the fold ``first`` over the rows of its component."""
    nodes = checkpointed(rows.groupBy("fp").agg(first.alias("first")))
    linked = components(near(nodes.select("fp"), bits))
    named = checkpointed(nodes.join(linked, nodes.fp == linked.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "first"))
    best = named.groupBy("component").agg(F.min("first").alias("first"))
    return named.select("fp", "component").join(best, "component").select("fp", "first")


def deduplicated(docs: DataFrame, words: int = 3, bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group stays the row with the smallest key, of equal keys the first.

    All columns stay. ``docs`` must come from files: rows are told apart by their place in the scan, which is read twice. A row
    with a null key stays only where its whole group has none.
    """
    at, stay = free_name(docs, "__row"), free_name(docs, "__kept")
    numbered = with_row_id(docs, at)
    rows = checkpointed(fingerprints(numbered, words, key, text, F.col(at)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = representatives(rows, bits, first).select(F.col("first.row").alias(stay)).distinct()
    return numbered.join(kept, F.col(at) == F.col(stay), "left_semi").drop(at)
