"""Alignment of two tokenizers: byte groups that both cut, and how often ids of the one end together with ids of the other."""

from __future__ import annotations

import hashlib
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import batch_of, per_text, slices, spread, texts
from paperloom.session import checkpointed, work_folder

#: A blank behind a character that no engine takes for white space: there both tokenizers cut.
#: ``BLANKS`` is what a text must hold for two cuts to differ from those at every blank.
CUT = re.compile("(?<=[^\\s\u180e\u200b])(?= )")
BLANKS = "[\\s\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\x0b\x1c-\x1f] "
ROWS = "slice long, kind int, doc_id long, n_a long, n_b long, n_groups long, groups string, codes binary, regular binary, regular_n binary, other binary, other_n binary, place int, pair long, n long"
ARROW_ROWS = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("codes", pa.binary()),
                        ("regular", pa.binary()), ("regular_n", pa.binary()), ("other", pa.binary()), ("other_n", pa.binary()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])
DOCUMENT, CHUNKS, PAIR, REGULAR = range(4)
WIDE = 1 << 32  # a pair as one number: id of A times this, and id of B


def byte_of() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as themselves and the others, in order, by the characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Aligner:
    """Distinct chunks of texts, each encoded by both tokenizers and aligned once; later batches of the task look them up.

    ``first``: a byte-level BPE of the tokenizers library, ``second``: a sentencepiece model with byte fallback that puts a blank
    in front. A chunk begins with a blank behind a character that is no white space; neither tokenizer has a token across it, so
    ids and groups of a text are those of its chunks.
    """

    def __init__(self, first: str, second: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.mark_id = self.b.piece_to_id("▁")
        shown = byte_of()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        ids = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in ids)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        # the identity map: the id of B with the same bytes, a written piece before a single byte; none is -1
        same = {t: i for i, t in enumerate(self.bytes_b) if self.b.is_byte(i)}
        same.update((t, i) for i, t in enumerate(self.bytes_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.identity = np.array([same.get(t, -1) if t else -1 for t in self.bytes_a], dtype=np.int64)
        self.show = [np.array([b"%d" % i + end for i in range(len(t))], dtype=object) for t, end in ((self.bytes_a, b","), (self.bytes_a, b"|"), (self.bytes_b, b","), (self.bytes_b, b";"))]
        self.most, self.known = most, {}

    def records(self, chunks: list[str]) -> list[tuple]:
        """Of each chunk: whether the bytes of both agree with it, numbers of ids and groups, the groups as text, its links.

        Links are the ids of A in one-to-one groups whose partner the identity map gives, and the other pairs as numbers.
        """
        known = self.known
        new = [c for c in chunks if c not in known]
        if new and len(known) + len(new) > self.most:  # only a cache
            for c in list(islice(known, max(0, len(known) + len(new) - self.most // 2))):
                del known[c]
            new = [c for c in chunks if c not in known]
        for k in range(0, len(new), 1 << 15):
            part = new[k : k + (1 << 15)]
            known.update(zip(part, self.align(part), strict=True))
        return [known[c] for c in chunks]

    def align(self, chunks: list[str]) -> list[tuple]:
        a = [e.ids for k in range(0, len(chunks), 4096) for e in self.a.encode_batch_fast(chunks[k : k + 4096], add_special_tokens=False)]
        b = [x if c != " " else [self.mark_id] for c, x in zip(chunks, self.b.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
        said = [c.encode() for c in chunks]
        ok = [c == b"".join(map(self.bytes_a.__getitem__, x)) == b"".join(map(self.bytes_b.__getitem__, y)) for c, x, y in zip(said, a, b)]
        a, b = ([x if fine else [] for x, fine in zip(ids, ok)] for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        last_a, last_b = end_a == cut[group_a], end_b == cut[group_b]
        in_a, in_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        left, right = flat_a[last_a], flat_b[last_b]
        regular = (in_a == 1) & (in_b == 1) & (self.identity[left] == right)
        whole = np.cumsum([len(c) if fine else 0 for c, fine in zip(said, ok)])
        owner = np.searchsorted(whole, cut)  # the chunk of each group; chunks without groups repeat the end before
        n_groups = np.bincount(owner, minlength=len(chunks))
        # the groups as text: ids of A, then ids of B, group by group
        out = np.empty(len(flat_a) + len(flat_b), dtype=object)
        before_b, through_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        for flat, last, place, (comma, end) in ((flat_a, last_a, np.arange(len(flat_a)) + before_b[group_a], self.show[:2]), (flat_b, last_b, np.arange(len(flat_b)) + through_a[group_b], self.show[2:])):
            out[place[last]], out[place[~last]] = end[flat[last]], comma[flat[~last]]
        ends = np.cumsum(n_a + n_b).tolist()
        plain, pairs = left[regular].astype("<u4"), (left * WIDE + right)[~regular].astype("<i8")
        at_plain, at_pairs = (np.concatenate(([0], np.cumsum(np.bincount(owner[m], minlength=len(chunks))))).tolist() for m in (regular, ~regular))
        return [(ok[i], int(n_a[i]), int(n_b[i]), int(n_groups[i]), b"".join(out[s:e]), plain[at_plain[i] : at_plain[i + 1]].tobytes(), pairs[at_pairs[i] : at_pairs[i + 1]].tobytes())
                for i, (s, e) in enumerate(zip([0, *ends], ends))]

    @staticmethod
    def chunked(col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Codes into the distinct chunks, offsets of the texts, the chunks; an empty text has none."""
        odd = pc.or_(pc.starts_with(col, " "), pc.match_substring_regex(col, BLANKS)).to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        easy = np.flatnonzero(~(odd | empty))
        lists = pc.split_pattern(col.take(pa.array(easy)), " ")
        flat = pc.binary_join_element_wise("", lists.flatten(), " ") if len(easy) else pa.array([], pa.string())
        hard = {int(i): CUT.split(" " + col[int(i)].as_py()) for i in np.flatnonzero(odd & ~empty)}
        coded = pa.chunked_array([flat, pa.array([c for x in hard.values() for c in x], pa.string())]).combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.zeros(len(col), dtype=np.int64)
        sizes[easy] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        for i, x in hard.items():
            sizes[i] = len(x)
        order = np.concatenate((easy, np.fromiter(hard, dtype=np.int64, count=len(hard))))
        first = np.zeros(len(col), dtype=np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return codes[spread(first, sizes)], np.concatenate(([0], np.cumsum(sizes))), coded.dictionary.to_pylist()


def rows_of(schema: pa.Schema, n: int, /, **cols) -> pa.RecordBatch:
    """A batch of ``n`` rows with nulls in the columns that are not given."""
    return batch_of(schema, *(cols.get(f.name, pa.nulls(n, f.type)) for f in schema))


def aligned(docs: DataFrame, first: str, second: str, folder: str, key: str, text: str, digest: bool) -> None:
    """Write the table of all that the counts and the sums need: documents, chunks and distinct irregular pairs of each slice, regular links of each task."""

    def run(batches):
        aligner, total, part = Aligner(first, second), None, TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, rows=8192, size=8 << 20)):
            name = (part << 33) + k
            codes, offsets, chunks = aligner.chunked(texts(batch))
            records = aligner.records(chunks)
            ok, n_a, n_b, n_groups = (np.array([r[i] for r in records], dtype=np.int64) for i in range(4))
            bad = per_text(1 - ok[codes], offsets) > 0
            if bad.any():  # their chunks take no part
                keep = ~np.repeat(bad, np.diff(offsets))
                codes, offsets = codes[keep], np.concatenate(([0], np.cumsum(np.where(bad, 0, np.diff(offsets)))))
            shown = np.array([r[4] for r in records], dtype=object)[codes] if len(records) else np.zeros(0, dtype=object)
            groups = [b"".join(shown[a:b])[:-1] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            del shown
            groups = [(hashlib.sha256(g).hexdigest() if digest else g.decode()) if g else "" for g in groups]
            raw = codes.astype("<u4").tobytes()
            yield rows_of(ARROW_ROWS, batch.num_rows, slice=np.full(batch.num_rows, name), kind=np.full(batch.num_rows, DOCUMENT, np.int32), doc_id=batch.column(0), groups=groups,
                          codes=[raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], **{c: per_text(v[codes], offsets).astype(np.int64) for c, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups))})
            times = np.bincount(codes, minlength=len(chunks))
            regular, other = np.frombuffer(b"".join(r[5] for r in records), "<u4"), np.frombuffer(b"".join(r[6] for r in records), "<i8")
            regular_n, other_n = (np.array([len(r[i]) // size for r in records], dtype=np.int64) for i, size in ((5, 4), (6, 8)))
            total = np.zeros(len(aligner.identity), dtype=np.int64) if total is None else total
            np.add.at(total, regular, np.repeat(times, regular_n))
            pairs, place = np.unique(other, return_inverse=True)
            yield rows_of(ARROW_ROWS, 1, slice=[name], kind=[CHUNKS], regular=[regular.tobytes()], regular_n=[regular_n.astype("<u4").tobytes()], other=[place.astype("<u4").tobytes()], other_n=[other_n.astype("<u4").tobytes()])
            n = np.bincount(place, weights=np.repeat(times, other_n), minlength=len(pairs)).astype(np.int64)
            yield rows_of(ARROW_ROWS, len(pairs), slice=np.full(len(pairs), name), kind=np.full(len(pairs), PAIR, np.int32), place=np.arange(len(pairs), dtype=np.int32), pair=pairs, n=n)
        if total is not None:
            some = np.flatnonzero(total)
            yield rows_of(ARROW_ROWS, len(some), kind=np.full(len(some), REGULAR, np.int32), pair=some, n=total[some])

    docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, ROWS).write.option("compression", "zstd").parquet(folder)


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row.

    A encodes a blank and the text, B the text, special tokens as plain text. Offsets where tokens of both end cut the ids into
    groups, written ``a1,a2|b1;a3|b2,b3`` (``digest``: its SHA-256 instead). A link is a pair of ids that end together; its count
    is that of the pair over all texts. ``n_best`` are links whose count is the highest of their B id, ``count_sum`` the sum of
    the counts of a text's links.

    1. Each task aligns its distinct chunks once. Links of one-to-one groups whose partner the identity map gives are counted in
       a vector as long as the vocabulary; only the other pairs, distinct in a slice of some megabytes and counted there, are
       shuffled. The table is written below the shared folder, so texts are encoded once.
    2. Spark adds up the pairs. The highest count of each B id is one row for each id of the vocabulary.
    3. Counts go back to the slices by a join on the pair, where a frequent pair has one row for each slice; the rows of a slice
       meet and sum up chunk by chunk.
    A text whose bytes either tokenizer does not give back (or null, or empty) has no tokens: zeros and an empty ``groups``.
    Null and repeated keys keep their rows; other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "alignment")
    aligned(docs, first, second, folder, key, text, digest)
    table = spark.read.schema(ROWS).parquet(folder)
    pairs = table.where(F.col("kind") == PAIR).select("slice", "place", "pair", "n")
    counts = checkpointed(pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    identity = Aligner(first, second).identity
    direct = np.zeros(len(identity), dtype=np.int64)
    got = table.where(F.col("kind") == REGULAR).groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # a row for each id of A at most
    direct[np.array(got["pair"], dtype=np.int64)] = np.array(got["n"], dtype=np.int64)
    top = counts.groupBy((F.col("pair") % WIDE).alias("b")).agg(F.max("count").alias("n")).toArrow().to_pydict()  # a row for each id of B at most
    best = np.zeros(max([int(identity.max()), *top["b"]], default=0) + 2, dtype=np.int64)
    best[np.array(top["b"], dtype=np.int64)] = np.array(top["n"], dtype=np.int64)
    np.maximum.at(best, identity[identity >= 0], direct[identity >= 0])
    direct_best = (direct == best[identity]) & (identity >= 0)
    schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])

    def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def add(own: pa.Table, counted: pa.Table) -> pa.Table:
        kind = own["kind"].to_numpy()
        table = own.filter(pa.array(kind == CHUNKS)).to_pylist()[0]
        regular, regular_n, other, other_n = (np.frombuffer(table[c], "<u4").astype(np.int64) for c in ("regular", "regular_n", "other", "other_n"))
        n, is_best = np.zeros(len(counted), dtype=np.int64), np.zeros(len(counted), dtype=np.int64)
        place, pair, count = (counted[c].to_numpy() for c in ("place", "pair", "count"))
        n[place], is_best[place] = count, count == best[pair % WIDE]
        worth = sums(direct[regular], regular_n) + sums(n[other], other_n)
        bests = sums(direct_best[regular].astype(np.int64), regular_n) + sums(is_best[other], other_n)
        docs = own.filter(pa.array(kind == DOCUMENT))
        raw = docs["codes"].to_pylist()
        codes, sizes = np.frombuffer(b"".join(raw), "<u4"), np.array([len(r) // 4 for r in raw], dtype=np.int64)
        return pa.Table.from_arrays([docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], docs["n_groups"], pa.array(sums(bests[codes], sizes)), pa.array(sums(worth[codes], sizes)), docs["groups"]], schema=schema)

    left = table.where(F.col("kind").isin(DOCUMENT, CHUNKS)).drop("place", "pair", "n")
    right = pairs.select("slice", "place", "pair").join(counts, "pair").select(F.col("slice").alias("of"), "place", "pair", "count")
    out = left.groupBy("slice").cogroup(right.groupBy("of")).applyInArrow(add, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("doc_id", key)
