"""Token-id files: documents in key order, cut into shards of Simple-8b blocks, written and read through Spark."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import simple8b
from paperloom.llm.chunks import WordTokenizer
from paperloom.llm.words import batch_of, slices, texts, with_row_id

BLOCK = "shard int, block int, first_id long, n_ids long, keys array<long>, sizes array<long>, words binary, escapes binary"
ARROW_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("escapes", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20, shards: int | None = None) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending key order.

    A shard is one range of keys and one task; a row of the file is one block: its place, the keys and sizes of its
    documents, and their ids as Simple-8b words. The texts are dealt out by range before they are tokenized, so the sampling
    of the ranges does not tokenize. Ties of the key are ordered by text hash and row number, so that a key or a text that
    holds a third of the rows is split as well. Null keys come first; a null text counts as empty; other columns are not read.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_row_id(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).withColumn("__hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, "key", "__hash", "__row").sortWithinPartitions("key", "__hash", "__row").select("key", "text")

    def encode(batches):
        tok, shard, first, block = WordTokenizer(tokenizer), TaskContext.get().partitionId(), 0, 0
        for part in slices(batches, rows=8192, size=block_bytes):
            ids, ends = tok(texts(part))
            sizes = np.diff(ends)
            flat = np.full(len(ids) + len(sizes), end_id, dtype=np.uint32)
            keep = np.ones(len(flat), dtype=bool)
            keep[np.cumsum(sizes + 1) - 1] = False
            flat[keep] = ids
            words, escapes = simple8b.encode(flat)
            yield batch_of(ARROW_BLOCK, [shard], [block], [first], [len(flat)], pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), [(sizes + 1).tolist()], [words.astype("<u8").tobytes()], [escapes.astype("<u8").tobytes()])
            first, block = first + len(flat), block + 1

    dealt.mapInArrow(encode, BLOCK).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """The documents of the files: ``key, start, n_tokens, ids_crc32`` and, on request, ``ids``.

    ``start`` counts the ids of all documents before: the block's place in its shard and the sum of the shards before, which
    is a table of one row for each shard.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    more = [("ids", pa.binary())] if ids else []
    schema = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *more])

    def decode(batches):
        for batch in batches:
            for b in batch.to_pylist():
                flat = simple8b.decode(np.frombuffer(b["words"], "<u8"), np.frombuffer(b["escapes"], "<u8"), b["n_ids"]).astype("<u4")
                ends = np.cumsum(b["sizes"])
                raw = [flat[e - n : e].tobytes() for e, n in zip(ends, b["sizes"])]
                yield batch_of(schema, [b["shard"]] * len(raw), b["keys"], ends - np.array(b["sizes"]) + b["first_id"], b["sizes"], [zlib.crc32(x) for x in raw], *[raw] * ids)

    docs = blocks.mapInArrow(decode, "shard int, key long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(base, "shard").select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
