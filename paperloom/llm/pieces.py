"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.chunks import PieceTokenizer, joined
from paperloom.llm.words import batch_of, slices, texts

KINDS = {"n_tokens": ("long", pa.int64()), "ids": ("binary", pa.binary()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", emit: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """``key`` and what ``emit`` names: the number of ids, the ids (unsigned 32-bit, little endian), the text decoded from
    them, and SHA-256 sums of the ids as decimals between commas and of the decoded text.

    No piece of the model crosses a marker, so each distinct marked word of a batch is segmented and decoded once; ids and
    texts are joined back by position. Nothing is shuffled. A null text counts as empty and has no ids; keys are passed on as
    they are, null or repeated; other columns are not read.
    """
    schema = pa.schema([("key", pa.int64()), *((c, KINDS[c][1]) for c in emit)])

    def run(batches):
        tok = PieceTokenizer(model)
        for part in slices(batches, size=4 << 20):
            codes, offsets, chunks = tok.chunked(texts(part))
            parts = tok.table.ids(chunks)
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            cols = {}
            if "n_tokens" in emit or "ids" in emit:
                flat, ends = joined(codes, offsets, parts)
                cols["n_tokens"] = np.diff(ends)
                cols["ids"] = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])] if "ids" in emit else None
            if "ids_sha256" in emit:
                digits = np.array([",".join(map(str, np.frombuffer(p, "<u4").tolist())) for p in parts], dtype=object)[codes] if len(parts) else []
                cols["ids_sha256"] = [hashlib.sha256(",".join(digits[a:b]).encode()).hexdigest() for a, b in spans]
            if "decoded" in emit or "decoded_sha256" in emit:
                shown = np.array(tok.surface(chunks, parts), dtype=object)[codes] if len(parts) else []
                plain = [b"".join(shown[a:b])[1:] for a, b in spans]
                cols["decoded"] = [p.decode() for p in plain] if "decoded" in emit else None
                cols["decoded_sha256"] = [hashlib.sha256(p).hexdigest() for p in plain]
            yield batch_of(schema, part.column(0), *(cols[c] for c in emit))

    sql = ", ".join(["key long", *(f"{c} {KINDS[c][0]}" for c in emit)])
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, sql).withColumnRenamed("key", key)
