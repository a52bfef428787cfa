"""Whitening of embeddings: spectra of partitions kept under rank-one updates, merged in a tree, refined over all vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.spectrum import Spectrum
from paperloom.llm.words import batch_of
from paperloom.session import checkpointed

FAN_IN = 16  # spectra that one task merges
SUMMARY = "dim int, part long, n long, sums array<string>, mean binary, values binary, basis binary"
ARROW_SUMMARY = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("values", pa.binary()), ("basis", pa.binary())])
TOP = 2**62  # integers beyond this are added in Python


@dataclass
class Fit:
    """Components of the vectors of one dimension, as columns, by falling variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.variance)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """``sum (n x - S)^2`` of each row, exact; none where it exceeds 63 bits."""
        most = self.n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < TOP:
            return (((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1)).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def usable(v: Column) -> Column:
    """Neither null nor holding a null or non-finite entry."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def by_dimension(lists: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places in the batch, and entries times ``scale`` rounded down, clipped to what a long holds."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    for d in np.unique(size).tolist():
        some = np.flatnonzero(size == d)
        x = np.floor(scale * flat[offsets[some][:, None] + np.arange(d)])
        yield d, some, np.where(x >= 2.0**63, 2**63 - 1, np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64))


def stacked(raw: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<i8").reshape(len(raw), d)


def grouped(batches) -> Iterator[tuple[int, np.ndarray]]:
    """Vectors of the fit list by dimension, a bounded number at a time."""
    for batch in batches:
        raw = batch.column(0).to_pylist()
        size = np.array([len(r) // 8 for r in raw], dtype=np.int64)
        for d in np.unique(size).tolist():
            some = np.flatnonzero(size == d)
            for k in range(0, len(some), 4096):
                yield d, stacked([raw[i] for i in some[k : k + 4096]], d)


def summary(part: int, spectra: dict[int, Spectrum]) -> Iterator[pa.RecordBatch]:
    for d, s in spectra.items():
        s.settle()
        yield batch_of(ARROW_SUMMARY, [d], [part], [s.n], pa.array([list(map(str, s.sums))], pa.list_(pa.string())), [s.mean.tobytes()], [s.values.tobytes()], [s.basis.tobytes()])


def from_summary(row: dict) -> Spectrum:
    d = row["dim"]
    return Spectrum(row["n"], np.frombuffer(row["mean"]).copy(), np.frombuffer(row["values"]).copy(), np.frombuffer(row["basis"]).reshape(d, d).copy(), [int(s) for s in row["sums"]])


def spectra(fit: DataFrame) -> dict[int, Spectrum]:
    """One spectrum for each dimension: partitions update their own, then ``FAN_IN`` at a time are merged until one is left."""

    def update(batches):
        own: dict[int, Spectrum] = {}
        for d, x in grouped(batches):
            s = own.setdefault(d, Spectrum.empty(d))
            total = x.sum(axis=0).tolist() if int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < TOP else x.astype(object).sum(axis=0).tolist()
            s.sums = [a + b for a, b in zip(s.sums, total)]
            for row in x.astype(np.float64):
                s.add(row)
        yield from summary(TaskContext.get().partitionId(), own)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.sort_by("part").to_pylist()
        total = from_summary(rows[0])
        for r in rows[1:]:
            total.merge(from_summary(r))
        return pa.Table.from_batches(list(summary(rows[0]["part"] // FAN_IN, {rows[0]["dim"]: total})), schema=ARROW_SUMMARY)

    found = fit.mapInArrow(update, SUMMARY)
    partitions = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max(1, math.ceil(math.log(max(partitions, 2), FAN_IN)))):
        found = found.groupBy("dim", F.floor(F.col("part") / FAN_IN).alias("of")).applyInArrow(merge, SUMMARY)
    out: dict[int, Spectrum] = {}
    for row in found.toArrow().sort_by([("dim", "ascending"), ("part", "ascending")]).to_pylist():  # one for each dimension
        s = from_summary(row)
        out.setdefault(row["dim"], Spectrum.empty(row["dim"])).merge(s)
    return out


def moments(fit: DataFrame, figures) -> dict[int, dict[tuple[int, int], float]]:
    """Sums over the fit list of products of the columns that ``figures(dim, x)`` gives, a column of ones behind them; halves only."""
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for d, x in grouped(batches):
            y = figures(d, x)
            y = np.column_stack((y, np.ones(len(y))))
            own[d] = own.get(d, 0) + y.T @ y
        for d, g in own.items():
            i, j = np.triu_indices(len(g))
            yield batch_of(schema, np.full(len(i), d, np.int32), i.astype(np.int32), j.astype(np.int32), g[i, j])

    got = fit.mapInArrow(run, "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).toArrow().to_pydict()
    out: dict[int, dict[tuple[int, int], float]] = {}
    for d, i, j, v in zip(got["dim"], got["i"], got["j"], got["total"]):
        out.setdefault(d, {})[i, j] = v
    return out


def square(cells: dict[tuple[int, int], float], k: int) -> np.ndarray:
    """The covariance of the first ``k`` figures: products centred by the means, over the count."""
    g = np.zeros((k + 1, k + 1))
    for (i, j), v in cells.items():
        g[i, j] = g[j, i] = v
    n = g[k, k]
    return g[:k, :k] / n - np.outer(g[k, :k], g[k, :k]) / n**2


def fitted(fit: DataFrame, components: int) -> dict[int, Fit]:
    """Fits by dimension. The merged basis spans the space, so one Rayleigh-Ritz step over all vectors makes it exact to rounding."""
    merged = spectra(fit)
    means = {d: np.array([v / s.n for v in s.sums]) for d, s in merged.items()}
    bases = {d: s.basis for d, s in merged.items()}
    ritz = moments(fit, lambda d, x: (x - means[d]) @ bases[d])
    out = {}
    for d, s in merged.items():
        value, turn = np.linalg.eigh(square(ritz[d], d)) if d else (np.zeros(0), np.zeros((0, 0)))
        value, vectors = value[::-1], (s.basis @ turn)[:, ::-1]
        trace = float(value.sum())
        # a variance that is rounding of zero has no direction
        k = min(components, int((value > 1e-12 * max(trace, 0.0)).sum())) if trace > 0 else 0
        vectors = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0) if k else vectors
        out[d] = Fit(s.n, s.sums, vectors, value[:k], value[:k] / trace if k else value[:k])
    check = moments(fit, lambda d, x: out[d].whiten(x))
    for d, f in out.items():
        k = len(f.variance)
        f.identity_error = float(np.abs(square(check[d], k) - np.eye(k)).max()) if k else 0.0
    return out


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each usable row and component up to ``components``.

    Entries times ``scale``, rounded down, are the integers x; the fit list holds each distinct x once. Vectors that are null or
    hold a null or non-finite entry are dropped. Vectors of different dimension are fitted apart. ``n`` is the length of the fit
    list, ``deviation`` the exact sum of ``(n x - S)^2``, null beyond 63 bits; ``explained`` is a component's share of the trace,
    ``identity_error`` the largest entry of the whitened vectors' covariance minus the identity. A component has positive
    variance, so there are fewer where the vectors span less, and none for a single distinct vector or an empty one.
    Null and repeated keys keep their rows; other columns are not read; an empty table gives an empty one.

    The fit list is shuffled once and checkpointed; each partition keeps a spectrum of dimension squared, whatever it reads.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    packed = pa.schema([("raw", pa.binary())])

    def pack(batches):
        for batch in batches:
            for _, _, x in by_dimension(batch.column(0), scale):
                yield batch_of(packed, [r.astype("<i8").tobytes() for r in x])

    fits = fitted(checkpointed(rows.select("v").mapInArrow(pack, "raw binary").distinct()), components)
    schema = pa.schema([("key", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches):
        for batch in batches:
            keys = batch.column(0)
            for d, some, x in by_dimension(batch.column(1), scale):
                f, m = fits[d], len(some)
                if not len(f.variance):
                    continue
                w, own, away = f.whiten(x), keys.take(pa.array(some)), pa.array(f.deviation(x), pa.int64())
                for c in range(len(f.variance)):
                    yield batch_of(schema, own, np.full(m, c + 1, np.int32), np.full(m, f.n), away, np.ascontiguousarray(w[:, c]), np.full(m, f.explained[c]), np.full(m, f.identity_error))

    return rows.mapInArrow(project, "key long, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("key", key)
