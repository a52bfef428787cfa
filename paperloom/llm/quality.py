"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network with calibrated output."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.labelled import sample, sigmoid, temperature, with_score
from paperloom.llm.words import batch_of, slices, split_words, texts

UNITS, DIM = 8192, 32
STEP = 1 << 15  # words whose vectors are spread out at once


def units_of(words: list[str]) -> np.ndarray:
    """Two units of each word, its first and its last three characters, hashed apart: a vocabulary of fixed size in which
    rare and new words share what they look like."""
    half = UNITS // 2
    return np.array([(zlib.crc32(w[:3].encode()) % half, half + zlib.crc32(w[-3:].encode()) % half) for w in words], dtype=np.int64).reshape(-1, 2)


def index_vectors() -> np.ndarray:
    """Sparse ternary index vector of each unit: two places, a sign each."""
    r = np.random.default_rng(20).integers(0, DIM, (UNITS, 2)), np.random.default_rng(21).choice((-1, 1), (UNITS, 2))
    out = np.zeros((UNITS, DIM), dtype=np.float32)
    for k in range(2):
        out[np.arange(UNITS), r[0][:, k]] += r[1][:, k]
    return out


def neighbours(x: np.ndarray, owner: np.ndarray, reach: int) -> np.ndarray:
    """Sum over the words at most ``reach`` places away in the same text."""
    out = np.zeros_like(x)
    for d in range(1, reach + 1):
        same = (owner[d:] == owner[:-d])[:, None]
        out[d:] += x[:-d] * same
        out[:-d] += x[d:] * same
    return out


def contexts(docs: DataFrame, reach: int = 2, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Context sums and counts of the units over all words of all texts.

    A task adds up its own words and hands out one row for each unit; Spark folds the rows of a unit. The result has a fixed
    size (``UNITS`` rows), whatever the input.
    """
    names = [f"c{d}" for d in range(DIM)]
    schema = pa.schema([("unit", pa.int32()), ("n", pa.int64()), *((c, pa.int64()) for c in names)])

    def run(batches):
        index, total, count = index_vectors(), np.zeros((UNITS, DIM)), np.zeros(UNITS, np.int64)
        for part in slices(batches, size=4 << 20):
            codes, offsets, words = split_words(texts(part))
            if not len(codes):
                continue
            u = units_of(words.to_pylist())
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            word = index[u[:, 0]] + index[u[:, 1]]
            by_word = np.zeros_like(word)
            for at in range(0, len(codes), STEP):
                lo, hi = max(0, at - reach), min(len(codes), at + STEP + reach)
                own = codes[at : at + STEP]
                around = neighbours(word[codes[lo:hi]], owner[lo:hi], reach)[at - lo :][: len(own)]
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
                by_word[own[order][first]] += np.add.reduceat(around[order], first, axis=0)
            n = np.bincount(codes, minlength=len(u))
            for k in range(2):
                order = np.argsort(u[:, k], kind="stable")
                own = u[order, k]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                total[own[first]] += np.add.reduceat(by_word[order], first, axis=0)
                count += np.bincount(u[:, k], weights=n, minlength=UNITS).astype(np.int64)
        some = np.flatnonzero(count)
        yield batch_of(schema, some.astype(np.int32), count[some], *(np.rint(total[some, d]).astype(np.int64) for d in range(DIM)))

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "unit int, n long, " + ", ".join(f"{c} long" for c in names))
    got = parts.groupBy("unit").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).toArrow().to_pandas()
    total, count = np.zeros((UNITS, DIM)), np.zeros(UNITS)
    at = got["unit"].to_numpy(dtype=np.int64)
    total[at], count[at] = got[names].to_numpy(dtype=np.float64), got["n"].to_numpy(dtype=np.float64)
    return total, count


def word_vectors(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Unit vectors: mean context, less the corpus mean, on length one; unseen units are zero."""
    mean = total / np.maximum(count, 1)[:, None]
    mean -= total.sum(axis=0) / max(count.sum(), 1)
    mean[count == 0] = 0
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean of its word vectors, of their squares, of the products of adjacent ones, and log length.

    Products of equal neighbours are squares, so texts that repeat a word stand out. A text without words is all zeros.
    """
    codes, offsets, words = split_words(col)
    out = np.zeros((len(col), 3 * DIM + 1), dtype=np.float32)
    n = np.diff(offsets)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    u = units_of(words.to_pylist())
    word = vectors[u[:, 0]] + vectors[u[:, 1]]
    owner = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(codes), STEP):
        x, own = word[codes[at : at + STEP + 1]], owner[at : at + STEP + 1]
        pairs = x[:-1] * x[1:] * (own[1:] == own[:-1])[:, None]
        k = min(STEP, len(codes) - at)
        first = np.flatnonzero(np.concatenate(([True], own[1:k] != own[: k - 1])))
        for j, v in enumerate((x[:k], x[:k] * x[:k], pairs if len(pairs) == k else np.concatenate((pairs, np.zeros_like(x[:1]))))):
            out[own[first], j * DIM : (j + 1) * DIM] += np.add.reduceat(v, first, axis=0)
    out[some, : 2 * DIM] /= n[some, None]
    out[some, 2 * DIM : 3 * DIM] /= np.maximum(n[some] - 1, 1)[:, None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Two layers; ``heat`` divides the logit."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    heat: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.heat)


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, decay: float = 1e-4, seed: int = 1) -> Network:
    """Adam on four fifths of the rows, the temperature on the rest. With one class only, the answer is its smoothed share."""
    p = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1] if x.ndim == 2 else 3 * DIM + 1
    r = np.random.default_rng(seed)
    if len(y) < 10 or len(np.unique(y)) < 2:
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    order = r.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, used = order[:cut], order[cut:]
    net = Network(x[used].mean(axis=0), x[used].std(axis=0) + 1e-3, r.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), float(np.log(p / (1 - p))))
    z = (x - net.shift) / net.scale
    moment, steps, size = [0] * 8, 0, 64 if len(used) < 4000 else 256
    for _ in range(epochs):
        for at in np.array_split(r.permutation(used), max(1, len(used) // size)):
            h = np.tanh(z[at] @ net.w1 + net.b1)
            e = (sigmoid(h @ net.w2 + net.b2) - y[at]) / len(at)
            back = e[:, None] * net.w2 * (1 - h * h)
            steps += 1
            for k, (name, g) in enumerate((("w1", z[at].T @ back + decay * net.w1), ("b1", back.sum(axis=0)), ("w2", h.T @ e + decay * net.w2), ("b2", e.sum()))):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                moment[k + 4] = 0.999 * moment[k + 4] + 0.001 * g * g
                setattr(net, name, getattr(net, name) - 3e-3 * (moment[k] / (1 - 0.9**steps)) / (np.sqrt(moment[k + 4] / (1 - 0.999**steps)) + 1e-8))
    net.heat = temperature(net.logit(x[held]), y[held])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    net: Network

    def __call__(self, col: pa.Array) -> np.ndarray:
        return np.clip(self.net(pooled(col, self.vectors)), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample_rows: int = 20_000, key: str = "doc_id", text: str = "text") -> Model:
    """Word vectors from all texts; the network from at most ``sample_rows`` labelled documents that ``usable`` admits.

    Without labels or with one class every text gets the smoothed share of label 1. Null texts count as empty; repeated rows
    count as often as they stand there.
    """
    vectors = word_vectors(*contexts(docs, text=text))
    names = [f"f{k}" for k in range(3 * DIM + 1)]
    schema = pa.schema([("label", pa.int32()), *((c, pa.float32()) for c in names)])

    def run(batches):
        for part in slices(batches, size=4 << 20):
            x = pooled(texts(part), vectors)
            yield batch_of(schema, part.column(1).cast(pa.int32()), *x.T)

    got = sample(docs, labels, label, usable, sample_rows, key, text).mapInArrow(run, "label int, " + ", ".join(f"{c} float" for c in names)).toArrow().to_pandas()
    got = got.sort_values(names + ["label"])  # the same order whichever task answers first
    return Model(vectors, fit(got[names].to_numpy(dtype=np.float64), got["label"].to_numpy(dtype=np.float64)))


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1. Nothing is shuffled."""
    return with_score(docs, name, lambda: model, text)
