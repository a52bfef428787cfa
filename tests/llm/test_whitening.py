"""Whitening against an eigendecomposition of the whole covariance."""

import collections
import math

import numpy as np

from paperloom.llm import whitening
from paperloom.llm.spectrum import Spectrum, secular_roots

SQL = "vec_id long, embedding array<float>, n int, key string, component string, v double"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x", "c", 0.5) for k, v in rows], SQL).repartition(3)


def check(rows, got, components=4):
    """Every figure of the operator from plain numpy over all vectors, dimension by dimension."""
    usable = [(k, v) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_dim = collections.defaultdict(list)
    for k, v in usable:
        by_dim[len(v)].append((k, [math.floor(256 * np.float32(x)) for x in v]))
    want = collections.Counter()
    for d, own in by_dim.items():
        fit = sorted({tuple(x) for _, x in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        x = np.array(fit, dtype=np.float64).reshape(n, d)
        c = x - x.mean(axis=0)
        value, vector = np.linalg.eigh(c.T @ c / n) if d else (np.zeros(0), np.zeros((0, 0)))
        value, vector = value[::-1], vector[:, ::-1]
        k = min(components, int((value > 1e-12 * value.sum()).sum())) if value.sum() > 0 else 0
        for key, v in own:
            for j in range(k):
                w = (np.array(v) - np.array(sums) / n) @ vector[:, j] / math.sqrt(value[j])
                want[key, j + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), round(abs(w), 6), round(value[j] / value.sum(), 9)] += 1
    assert collections.Counter((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 6), round(r.explained, 9)) for r in got) == want
    assert all(r.identity_error < 1e-9 for r in got)


def test_whitening(spark):
    r = np.random.default_rng(7)
    mix = r.normal(size=(6, 6))
    rows = [(i, (r.normal(size=6) @ mix).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(100)]  # copies count once in the fit
    rows += [(500, None), (501, [float("nan")] * 6), (502, [None] + [1.0] * 5), (503, [float("inf")] + [0.0] * 5), (504, []), (505, [1.0, 2.0]), (506, [0.5, -2.0]), (507, [3.0] * 7), (None, rows[3][1]), (7, rows[9][1])]
    got = whitening.whiten(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    check(rows, got)
    for j in (1, 2, 3, 4):  # one sign for all rows
        a = {r.vec_id: r.whitened for r in got if r.component == j and r.n > 10 and r.vec_id is not None and r.vec_id < 300}
        assert min(a.values()) < 0 < max(a.values())


def test_few_directions_and_empty_tables(spark):
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 1.0]) for i in range(20)]
    got = whitening.whiten(frame(spark, flat)).collect()
    assert {r.component for r in got} == {1}
    check(flat, got)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, flat).limit(0)).count() == 0


def test_deviation_is_exact_or_null(spark):
    wide = [(1, [1e6, 0.0]), (2, [-1e6, 5.0]), (3, [123456.0, 7.0])]
    check(wide, whitening.whiten(frame(spark, wide)).collect())
    huge = whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [1.0, 7.0])])).collect()
    assert huge and all(r.deviation is None for r in huge if r.vec_id != 3)


def test_secular_roots():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 30):
        d = np.sort(r.normal(size=n)) + np.arange(n)
        z = r.normal(size=n) * 10.0 ** r.integers(-6, 1, n)
        base, off = secular_roots(d, z * z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.allclose(np.sort(d[base] + off), want, rtol=0, atol=1e-12 * (1 + abs(want).max()))


def test_updates_and_merges_keep_the_scatter():
    r = np.random.default_rng(2)
    for case in range(12):
        d = int(r.integers(1, 12))
        x = np.floor(256 * r.normal(size=(int(r.integers(1, 60)), d)))
        x[:, -1] = x[:, 0] if case % 3 == 0 else x[:, -1]  # two directions with one variance, and none
        x[r.random(len(x)) < 0.3] = x[0]
        parts = []
        for own in np.array_split(x, 1 + case % 4):
            s = Spectrum.empty(d)
            for row in own:
                s.add(row)
            parts.append(s)
        for other in parts[1:]:
            parts[0].merge(other)
        s, c = parts[0], x - x.mean(axis=0)
        scale = 1 + np.abs(c.T @ c).max()
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0))
        assert np.abs(s.basis @ np.diag(s.values) @ s.basis.T - c.T @ c).max() < 1e-11 * scale
        assert np.abs(s.basis.T @ s.basis - np.eye(d)).max() < 1e-12
