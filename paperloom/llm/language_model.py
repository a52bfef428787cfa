"""Scoring of texts by a recurrent language model and by the unigram model of the same training texts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import gru
from paperloom.llm.words import batch_of, per_text, slices, split_words, texts, with_row_id
from paperloom.session import checkpointed

END = "\n"  # the end token, which no word can be
BLOCK = 1 << 14  # weights in a row when networks are averaged


LONG = 64  # bytes; longer words travel and are looked up by a 128-bit digest, so that a table of words has a size


def short_key(word: Column) -> Column:
    """The word, or for a long one a digest that no word can be."""
    return F.when(F.octet_length(word) <= LONG, word).otherwise(F.concat(F.lit(END), F.md5(word.cast("binary"))))


def short_keys(words: list[str]) -> list[str]:
    """The same in a task."""
    return [w if len(w) <= LONG // 4 or len(b := w.encode()) <= LONG else END + hashlib.md5(b).hexdigest() for w in words]


def key_array(words: pa.Array) -> pa.Array:
    """The same for a column of words."""
    long = pc.greater(pc.binary_length(words), LONG)
    if not pc.any(long, min_count=0).as_py():
        return words
    return pc.replace_with_mask(words, long, pa.array(short_keys(words.filter(long).to_pylist()), words.type))


def first_bytes(words: pa.Array) -> np.ndarray:
    """The first byte of each word; no word is empty."""
    if not len(words):
        return np.zeros(0, np.uint8)
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)]
    return np.frombuffer(words.buffers()[2], np.uint8)[starts]


def lowered(part: pa.RecordBatch) -> pa.Array:
    return pc.ascii_lower(texts(part))


def token_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts, the end token included. Batches count first, then tasks, then Spark."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for part in slices(batches, rows=8192, size=8 << 20):
            codes, _, words = split_words(lowered(part))
            yield batch_of(schema, pa.concat_arrays([words, pa.array([END])]), np.append(np.bincount(codes, minlength=len(words)), part.num_rows))

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_counts(words: DataFrame) -> DataFrame:
    """``gram, n``: byte trigrams of the distinct words, a blank behind each; the first byte's context is (0, 0)."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            col = batch.column(0)
            codes = byte_contexts(col)[0]
            gram, n = np.unique(codes, return_counts=True)
            yield batch_of(schema, gram.astype(np.int32), n)

    return words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def byte_contexts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of every byte and of the blank behind each word; offsets of the words."""
    size = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col.cast(pa.string())), " ")[0].as_py()
    b = np.frombuffer((raw + " ").encode(), np.uint8).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size + 1)))
    one, two = np.concatenate(([0], b[:-1])), np.concatenate(([0, 0], b[:-2]))
    first = ends[:-1]
    one[first] = 0
    two[first] = 0
    two[first[size > 0] + 1] = 0
    return two * 65536 + one * 256 + b, ends


@dataclass
class Spelling:
    """Log10 probability of a byte after two others; contexts that no word has go by the last byte."""

    row: np.ndarray
    table: np.ndarray
    short: np.ndarray

    def __call__(self, col: pa.Array) -> np.ndarray:
        """Of each word given its first byte, the end included."""
        codes, ends = byte_contexts(col)
        at = self.row[codes >> 8]
        v = np.where(at >= 0, self.table[np.maximum(at, 0), codes & 255], self.short[(codes >> 8) & 255, codes & 255]).astype(np.float64)
        v[ends[:-1]] = 0
        return per_text(v, ends)


def spelling(grams: np.ndarray, n: np.ndarray) -> Spelling:
    ctx, inverse = np.unique(grams >> 8, return_inverse=True)
    seen = np.zeros((len(ctx), 256))
    np.add.at(seen, (inverse, grams & 255), n)
    pair = np.zeros((256, 256))
    np.add.at(pair, ((grams >> 8) & 255, grams & 255), n)
    one = (pair.sum(axis=0) + 0.1) / (pair.sum() + 25.6)
    two = (pair + 4 * one) / (pair.sum(axis=1, keepdims=True) + 4)
    three = (seen + 4 * two[ctx & 255]) / (seen.sum(axis=1, keepdims=True) + 4)
    row = np.full(65536, -1, np.int32)
    row[ctx] = np.arange(len(ctx))
    return Spelling(row, np.log10(three).astype(np.float32) if len(ctx) else np.zeros((1, 256), np.float32), np.log10(two).astype(np.float32))


@dataclass
class Model:
    symbol: dict[str, int]
    unknown: np.ndarray  # symbol of an unlisted word by its first byte
    net: gru.Gru
    common: pa.Array  # words whose counts travel with the model
    counts: np.ndarray
    spell: Spelling
    tokens: int
    types: int
    listed_share: float  # of an unlisted word's probability, what goes by its count
    scale: np.ndarray  # that share over the tokens of unlisted words, by first byte

    def symbols(self, words: list[str]) -> np.ndarray:
        return self.looked_up(pa.array(words, pa.string()), self.common.slice(0, len(self.symbol)))[2]

    def looked_up(self, words: pa.Array, names: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Keys of the words, their places in ``names`` (-1: not there) and their symbols. The words with a symbol are the first of ``common``
        and the first of ``symbol``."""
        keys = key_array(words)
        at = pc.fill_null(pc.index_in(keys, value_set=names), -1).to_numpy(zero_copy_only=False)
        own, out = np.fromiter(self.symbol.values(), np.int64, len(self.symbol)), self.unknown[first_bytes(words)]
        listed = np.flatnonzero((at >= 0) & (at < len(own)))
        out[listed] = own[at[listed]]
        return keys, at, out


def with_ends(codes: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end`` behind each text."""
    lengths = np.diff(offsets) + 1
    out = np.full(len(codes) + len(lengths), end, dtype=np.int64)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths) - 1] = False
    out[keep] = codes
    return out, lengths


def train(docs: DataFrame, hidden: int = 16, classes: int = 48, members: int = 48, common: int = 300_000, steps: int = 16, rate: float = 0.03, rounds: int = 1) -> tuple[Model, DataFrame]:
    """The model of the texts in ``docs`` (column ``text``) and the counts ``word, n`` of all their tokens.

    Symbols: the end, the most frequent words, and for other words one symbol for each first byte; a word behind such a symbol
    has its share of the counts, mixed with a byte model of the spelling of all distinct words. Counts, shares and
    spellings come from all texts. The network takes every window of every text, the state carried from the text's start;
    each task trains a copy, Spark averages the copies by tokens, in blocks and two steps, so no task or driver holds more
    than a part of them.
    """
    counts = checkpointed(token_counts(docs))
    listed = classes * members - 257
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = int(total.n or 0), int(total.v)
    first = F.conv(F.substring(F.hex(F.substring("word", 1, 1).cast("binary")), 1, 2), 16, 10).cast("int")
    top = counts.where(F.col("word") != END).select(short_key(F.col("word")).alias("word"), first.alias("byte"), "n").orderBy(F.desc("n"), "word").limit(common).toArrow()
    names, n = top["word"].combine_chunks(), top["n"].to_numpy().astype(np.int64)
    inner = names.to_pylist()[:listed]
    firsts = counts.where(F.col("word") != END).groupBy(first.alias("byte")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once")).toArrow().to_pandas()
    per_byte, once = np.zeros(256), 0
    per_byte[firsts["byte"].to_numpy(dtype=np.int64)] = firsts["n"].to_numpy(dtype=np.float64)
    once = float(firsts["once"].sum())
    for b, k in zip(top["byte"].to_pylist()[: len(inner)], n):
        per_byte[b] -= k
    # symbols by frequency: the end is symbol 0, the rest falls into classes in order
    ends = max(tokens - int(firsts["n"].sum()), 0) if len(firsts) else tokens
    weight = np.concatenate((n[: len(inner)], per_byte)).astype(np.float64)
    order = np.argsort(-weight, kind="stable")
    place = np.empty(len(weight), np.int64)
    place[order] = np.arange(1, len(weight) + 1)
    freq = np.full(classes * members, 0.0)
    freq[0], freq[place] = ends, weight
    log_share = np.log((freq + 0.05) / (freq.sum() + 0.05 * len(freq)))
    grams = spelling_counts(counts.where(F.col("word") != END)).toArrow()
    unlisted = max(per_byte.sum(), 1.0)
    mixed = float(np.clip(1 - once / unlisted, 0.05, 0.95))
    net = gru.initial(log_share, members, hidden)
    model = Model(dict(zip(inner, place[: len(inner)].tolist())), place[len(inner) :], net, names, n, spelling(grams["gram"].to_numpy().astype(np.int64), grams["n"].to_numpy()), tokens, types, mixed, mixed / np.maximum(per_byte, 1))
    for _ in range(rounds):
        model.net = averaged(docs, model, steps, rate)
    return model, counts


def averaged(docs: DataFrame, model: Model, steps: int, rate: float) -> gru.Gru:
    """One round: every task trains a copy of the network on its texts; the copies are averaged by the tokens they saw."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("tokens", pa.float64()), ("sum", pa.binary())])
    sql = "part int, block int, tokens double, sum binary"

    def run(batches):
        net = model.net.unpacked(model.net.packed())
        adam, seen, frequent = gru.Adam(net, rate), 0, model.common.slice(0, len(model.symbol))
        for part in slices(batches, rows=8192, size=8 << 20):
            codes, offsets, words = split_words(lowered(part))
            flat, lengths = with_ends(model.looked_up(words, frequent)[2][codes], offsets, 0)
            gru.train(net, adam, flat, lengths, steps=steps)
            seen += len(flat)
        if seen:
            flat = net.packed().astype(np.float64) * seen
            for b, at in enumerate(range(0, len(flat), BLOCK)):
                yield batch_of(schema, [TaskContext.get().partitionId() % 32], [b], [float(seen)], [flat[at : at + BLOCK].tobytes()])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in group["sum"])
        return pa.Table.from_batches([batch_of(schema, [0], [group["block"][0].as_py()], [float(sum(group["tokens"].to_pylist()))], [total.tobytes()])])

    copies = docs.select("text").mapInArrow(run, sql)
    blocks = copies.groupBy("part", "block").applyInArrow(added, sql).groupBy("block").applyInArrow(added, sql).toArrow().sort_by("block").to_pylist()
    if not blocks:
        return model.net
    return model.net.unpacked(np.concatenate([np.frombuffer(b["sum"], np.float64) / b["tokens"] for b in blocks]))


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Tasks score what they know: the network on whole texts, common words by the counts that travel with the model. Words
    that are not among the most frequent ones leave as rows and meet the table of all counts in a join; a text without
    such words has a key of its own there, so no key is hot. A null text is its end alone.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("__row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("net", pa.float64()),
                        ("rare", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64()), ("spell", pa.float64()), ("scale", pa.float64())])))])
    sql = "doc_id long, __row long, n_tokens long, known long, base double, net double, rare array<struct<word: string, n: long, spell: double, scale: double>>"
    floor = float(np.log10(model.tokens + model.types + 1.0))
    end_count = per_end(counts)
    rest = float(np.log10(1 - model.listed_share))
    share = model.listed_share

    def run(batches):
        end_base = np.log10(end_count + 1) - floor
        for part in slices(batches, rows=8192, size=8 << 20):
            codes, offsets, words = split_words(lowered(part))
            keys, place, sym = model.looked_up(words, model.common)
            flat, lengths = with_ends(sym[codes], offsets, 0)
            logs = gru.score(model.net, flat, lengths) / np.log(10)
            net = per_text(logs, np.concatenate(([0], np.cumsum(lengths))))
            inner = (place >= 0) & (place < len(model.symbol))
            c = np.full(len(place), -1, np.int64)
            c[place >= 0] = model.counts[place[place >= 0]]
            base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0) - floor, 0.0)
            spell, scale = np.zeros(len(words)), np.zeros(len(words))
            some = np.flatnonzero(~inner)
            if len(some):
                spell[some] = model.spell(words.take(pa.array(some)))
                scale[some] = model.scale[first_bytes(words)[some]]
            with np.errstate(divide="ignore"):
                mixed = np.where(inner, 0.0, np.log10(scale * np.maximum(c, 0) + (1 - share) * 10.0**spell))
            extra = np.where(c >= 0, np.where(c > 0, mixed, rest + spell), 0.0)
            extra[inner] = 0
            known = per_text((c > 0)[codes].astype(float), offsets)
            rare = c < 0
            at = np.flatnonzero(rare[codes])
            owner = np.repeat(np.arange(len(lengths)), np.diff(offsets))[at]
            pair, n = np.unique(owner * max(len(words), 1) + codes[at], return_counts=True)
            who, what = pair // max(len(words), 1), pair % max(len(words), 1)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(lengths) + 1)), pa.int32()),
                                             pa.StructArray.from_arrays([keys.take(pa.array(what)), pa.array(n.astype(np.int64)), pa.array(spell[what]), pa.array(scale[what])], fields=list(schema.field("rare").type.value_type)))
            yield batch_of(schema, part.column(0), part.column(2), lengths, known.astype(np.int64) + (1 if end_count > 0 else 0), per_text(base[codes], offsets) + end_base, net + per_text(extra[codes], offsets), lists)

    rows = with_row_id(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, sql)
    each = rows.select("doc_id", "__row", "n_tokens", "known", "base", "net", F.explode_outer("rare").alias("r")).select("*", F.coalesce("r.word", F.concat(F.lit(END), F.col("__row"))).alias("word"), F.col("r.n").alias("times"), "r.spell", "r.scale").drop("r")
    met = each.join(counts.select(short_key(F.col("word")).alias("word"), F.col("n").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0))
    by_count = F.when(c > 0, F.log10(F.col("scale") * c + (1 - share) * F.pow(F.lit(10.0), "spell"))).otherwise(F.lit(rest) + F.col("spell"))
    out = met.groupBy("__row").agg(*(F.first(x).alias(x) for x in ("doc_id", "n_tokens", "known", "base", "net")),
                                   F.sum(F.when(F.col("times").isNotNull() & (c > 0), F.col("times")).otherwise(0)).alias("more"),
                                   F.sum(F.when(F.col("times").isNotNull(), F.col("times") * (F.log10(c + 1.0) - floor)).otherwise(0.0)).alias("base2"),
                                   F.sum(F.when(F.col("times").isNotNull(), F.col("times") * by_count).otherwise(0.0)).alias("net2"))
    return out.select(F.col("doc_id").alias(key), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("base2")).alias("base_score"), (F.col("net") + F.col("net2")).alias("score"))


def per_end(counts: DataFrame) -> int:
    """How many training texts there are: the count of the end token."""
    got = counts.where(F.col("word") == END).first()
    return int(got.n) if got else 0
