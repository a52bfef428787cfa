"""Packing of documents into sequences of bounded length with a bounded number of open windows in each partition."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.chunks import WordTokenizer
from paperloom.llm.words import batch_of, slices, texts
from paperloom.session import checkpointed

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open int"
ARROW_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.int32())]
#: Sequence ids of the merge begin here; those of partition p begin at p * 2 ** 33.
MERGED = 1 << 62


class Windows:
    """At most ``most`` open windows of ``size`` tokens, by free room. An item is (length, pieces)."""

    def __init__(self, size: int, most: int | None):
        self.size, self.most = size, most
        self.open: list[tuple[int, int, list]] = []  # free room, number, pieces
        self.made = 0

    def add(self, length: int, pieces: list) -> Iterator[list]:
        """Place an item where the least room stays; if it fits nowhere, open a window and give out the fullest beyond ``most``."""
        at = bisect.bisect_left(self.open, (length,))
        if at < len(self.open):
            free, number, held = self.open.pop(at)
            held.extend(pieces)
        else:
            if self.most and len(self.open) >= self.most:
                yield self.open.pop(0)[2]
            free, number, held = self.size, self.made, list(pieces)
            self.made += 1
        if free == length:
            yield held
        else:
            bisect.insort(self.open, (free - length, number, held))

    def rest(self) -> list[list]:
        return [held for _, _, held in self.open]


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, windows: int = 32, merge: int = 64, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, on request with ``ids``.

    A document of more than ``size`` ids is cut into whole windows and a rest; rests go best-fit into the open windows of the
    partition that reads them (no shuffle of texts). What is open at the end of a partition is packed once more, over
    ``merge`` partitions at a time, again best-fit, the largest first. So a task holds ``windows`` windows, a merge
    ``windows * merge`` of them, whatever the input. A sequence is padded to ``size`` by the reader.

    A null or empty text is its end id alone; null and repeated keys are packed like any other; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema(ARROW_PIECE + [("ids", pa.binary())] * ids)
    sql = PIECE + ", ids binary" * ids

    def out(sequences):
        """sequences: (sequence id, open, pieces)."""
        cols = [[] for _ in schema]
        for sid, is_open, pieces in sequences:
            offset = 0
            for p in pieces:
                for c, v in zip(cols, (*p[:5], sid, offset, is_open, *p[5:])):
                    c.append(v)
                offset += p[2]
        return batch_of(schema, *cols)

    def place(batches):
        tok, pid, made, held = WordTokenizer(tokenizer), TaskContext.get().partitionId(), 0, Windows(size, windows)
        for part in slices(batches, rows=8192, size=8 << 20):
            flat, ends = tok(texts(part))
            done = []
            for doc, a, b in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), size):
                    raw = own[at : at + size].tobytes()
                    piece = (doc, at, len(raw) // 4, zlib.crc32(raw), len(own), *[raw] * ids)
                    for full in held.add(piece[2], [piece]):
                        done.append(((pid << 33) + made, 0, full))
                        made += 1
            if done:
                yield out(done)
        if rest := held.rest():
            yield out([((pid << 33) + made + i, 1, pieces) for i, pieces in enumerate(rest)])

    placed = checkpointed(rows.mapInArrow(place, sql))

    def merged(table: pa.Table) -> pa.Table:
        got, group = {}, table.column("__group")[0].as_py()
        for r in zip(*(table.column(n).to_pylist() for n in schema.names)):
            got.setdefault(r[5], []).append((r[6], (*r[:5], *r[8:])))
        items = sorted(((sum(p[2] for _, p in v), k, [p for _, p in sorted(v, key=lambda x: x[0])]) for k, v in got.items()), key=lambda x: (-x[0], x[1]))
        held = Windows(size, None)
        done = [full for n, _, pieces in items for full in held.add(n, pieces)] + held.rest()
        return pa.Table.from_batches([out([(MERGED + (group << 33) + i, 0, pieces) for i, pieces in enumerate(done)])])

    left = placed.where("open = 1").withColumn("__group", F.shiftright("sequence_id", 33).cast("long") / F.lit(merge)).withColumn("__group", F.col("__group").cast("long"))
    return placed.where("open = 0").union(left.groupBy("__group").applyInArrow(merged, sql)).drop("open")
