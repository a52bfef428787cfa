"""WARC archives: records with repeated payloads as revisits, segmented records, reassembly and chunked framing."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.words import batch_of, slices, texts

END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def head(*fields: tuple[str, object]) -> bytes:
    return END.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields if v is not None)]) + END + END


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(f"{len(p):x}".encode() + END + p + END for p in parts) + b"0" + END + END


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        stop = body.index(END, at)
        n = int(body[at:stop].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if body[stop + 2 + n : stop + 4 + n] != END:
            raise ValueError("chunk without its end")
        out.append(body[stop + 2 : stop + 2 + n])
        at = stop + 4 + n


def write(pages: DataFrame, path: str, revisit_from: int = 0, segment_bytes: int = 32 << 10, chunk_bytes: int = 4 << 10, records_per_file: int = 2048, date: str = "2000-01-01T00:00:00Z",
          key: str = "page_id", url: str | None = "url", html: str = "html") -> None:
    """Write one record for each page; its payload is the html in UTF-8, null counts as empty.

    Of the pages with one payload of at least ``revisit_from`` bytes, that with the largest key is a response and the others
    revisit it; shorter ones are all responses. The largest key comes from a fold by digest; the rows meet it in a join whose
    large partitions adaptive execution splits, so a payload that a third of the pages share stays spread. Repeated rows
    with the largest key are all responses; a null key is never the largest unless all are null. A block of more than
    ``segment_bytes`` is cut into continuation records. Spark's text writer puts the files in place (gzip, at most
    ``records_per_file`` records of bounded size each): a record ends with two line ends, which is its line separator.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"), F.col(html).alias("text"))
    hashed = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("sum", pa.string())])

    def summed(batches):
        for part in slices(batches):
            col = texts(part)
            raw = [x.encode() for x in col.to_pylist()]
            yield batch_of(hashed, part.column(0), part.column(1), col, [len(x) for x in raw], [digest(x) for x in raw])

    digests = rows.mapInArrow(summed, "page_id long, url string, text string, n long, sum string")
    most = digests.where(F.col("n") >= revisit_from).groupBy("sum").agg(F.max("page_id").alias("most"))
    joined = digests.join(most, "sum", "left").withColumn("at", F.monotonically_increasing_id()).select("page_id", "url", "text", "n", "sum", "most", "at")
    out = pa.schema([("record", pa.binary())])

    def records(batches):
        for part in slices(batches):
            done = []
            for page, link, body, n, total, top, at in zip(*(c.to_pylist() for c in part.columns)):
                name = f"<urn:page:{page}:{at}>"
                link = None if link is None else "".join(c if c > " " else "%{:02X}".format(ord(c)) for c in link)
                common = [("WARC-Date", date), ("WARC-Target-URI", link), ("Page-Id", page), ("WARC-Payload-Digest", "sha1:" + total)]
                if top is not None and top != page:
                    block = b"HTTP/1.1 200 OK" + END + f"Content-Length: {n}".encode() + END + END
                    done.append(head(("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{top}>"), ("Content-Length", len(block))) + block)
                    continue
                block = b"HTTP/1.1 200 OK" + END + b"Content-Type: text/html; charset=utf-8" + END + b"Transfer-Encoding: chunked" + END + END + chunked(body.encode(), chunk_bytes)
                cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                for k, cut in enumerate(cuts, 1):
                    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
                    later = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name)]
                    part_of = [("WARC-Segment-Number", k)] if len(cuts) > 1 else []
                    last = [("WARC-Segment-Total-Length", len(block))] if k == len(cuts) > 1 else []
                    done.append(head(*(first if k == 1 else later), *part_of, *last, ("Content-Length", len(cut))) + cut)
            yield batch_of(out, done)

    written = joined.mapInArrow(records, "record binary").select(F.col("record").cast("string"))
    written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parsed(content: bytes):
    """Fields and block of each record of a file."""
    data, at = zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content, 0
    while at < len(data):
        stop = data.index(END + END, at)
        lines = data[at:stop].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        begin = stop + 4
        at = begin + int(fields["Content-Length"])
        yield fields, data[begin:at]
        at += 4


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
ARROW_RESULT = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]


def number(text: str) -> int | None:
    return None if text == "None" else int(text)


def opened(fields: dict, block: bytes, whole: bool = True) -> tuple:
    """Result row and payload of a complete record."""
    top, _, body = block.partition(END + END)
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = number(fields.get("Page-Id", "None"))
    if fields["WARC-Type"] == "revisit":
        n = int(top.split(b"Content-Length: ")[1].split(END)[0])
        return page, n, said, "revisit", number(fields["WARC-Refers-To"][10:-1]), whole, None
    try:
        payload = unchunked(body) if b"Transfer-Encoding: chunked" in top else body
    except ValueError:
        payload, whole = body, False
    got = digest(payload)
    return page, len(payload), got, "response", None, whole and got == said, payload


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Read archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``, on request ``payload``.

    Whole records are decoded where they are read. Segments are grouped by their origin, ordered by number, checked against
    the total length and decoded; a group is one payload. ``intact`` is false for a wrong length, number, frame or digest.
    A revisit's length is the one its headers keep of the response it refers to.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = pa.schema(ARROW_RESULT + [("payload", pa.binary())] * payload)
    sql = RESULT + ", payload binary" * payload
    cut = pa.schema([("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def whole(batches):
        for batch in batches:
            for content in batch.column(0):
                got = [opened(f, b)[: len(schema)] for f, b in parsed(content.as_py()) if "WARC-Segment-Number" not in f]
                if got:
                    yield batch_of(schema, *map(list, zip(*got)))

    def segments(batches):
        for batch in batches:
            for content in batch.column(0):
                got = [(f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), int(f["WARC-Segment-Number"]), int(f["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in f else None, list(f.items()), b)
                       for f, b in parsed(content.as_py()) if "WARC-Segment-Number" in f]
                if got:
                    yield batch_of(cut, *map(list, zip(*got)))

    def reassemble(group: pa.Table) -> pa.Table:
        parts = sorted(group.to_pylist(), key=lambda r: r["segment"])
        block = b"".join(r["block"] for r in parts)
        ordered = [r["segment"] for r in parts] == list(range(1, len(parts) + 1))
        return pa.Table.from_batches([batch_of(schema, *([x] for x in opened(dict(parts[0]["fields"]), block, ordered and parts[-1]["total"] == len(block))[: len(schema)]))])

    parts = files.mapInArrow(segments, "origin string, segment long, total long, fields map<string,string>, block binary")
    return files.mapInArrow(whole, sql).union(parts.groupBy("origin").applyInArrow(reassemble, sql))
