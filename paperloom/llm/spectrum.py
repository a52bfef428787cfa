"""Eigendecomposition of a scatter matrix kept under rank-one updates: secular equations, deflation, merging of spectra."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum w / (d - x)``, for ascending distinct ``d`` and positive ``w``: one above each pole.

    A root is given as the nearer pole's index and the distance from it, so that differences to poles keep full precision.
    Steps solve the equation with its two neighbouring poles fitted; a step that leaves the bracket becomes a bisection.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    at = np.arange(n)
    with np.errstate(all="ignore"):
        left = 1 + (w / ((d - d[:, None]) - gap[:, None] / 2)).sum(axis=1) >= 0
    left[-1] = True
    base = np.where(left, at, np.minimum(at + 1, n - 1))
    lo, hi = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    hi[-1] = gap[-1]
    off = (lo + hi) / 2
    shift = d - d[base][:, None]
    low_pole, high_pole = d - d[base], upper - d[base]
    below = (at[None, :] <= at[:, None]).astype(np.float64)  # poles up to the root's own
    live = at  # roots not found yet
    for _ in range(100):
        o = off[live]
        delta = shift[live] - o[:, None]
        with np.errstate(all="ignore"):
            term = w / delta
            slope = term / delta
            f = 1 + term.sum(axis=1)
            rough = 1 + np.abs(term).sum(axis=1)  # what f's rounding is measured by
            lo[live], hi[live] = np.where(f < 0, o, lo[live]), np.where(f > 0, o, hi[live])
            low, high = low_pole[live] - o, high_pole[live] - o
            all_slope = slope.sum(axis=1)
            low_slope = (slope * below[live]).sum(axis=1)
            a = (low + high) * f - low * high * all_slope
            b = low * high * f
            c = f - low * low_slope - high * (all_slope - low_slope)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = o + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where((new > lo[live]) & (new < hi[live]), new, (lo[live] + hi[live]) / 2)
        found = (np.abs(f) <= 4 * EPS * rough) | (np.abs(new - o) <= 2 * EPS * np.abs(o))
        off[live] = np.where(found, o, new)
        live = live[~found]
        if not len(live):
            break
    return base, off


@dataclass
class Spectrum:
    """Scatter of vectors about their mean as eigenvalues (ascending) and orthonormal columns; the exact sums of integer vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    sums: list[int]

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim), [0] * dim)

    def rank_one(self, u: np.ndarray) -> None:
        """Add ``u u^T``."""
        z = self.basis.T @ u
        norm = float(np.linalg.norm(z))
        if norm == 0:
            return
        tol = 8 * EPS * max(float(self.values[-1]), norm * norm)
        # equal values: a reflection leaves one of them with a share in u
        edge = np.flatnonzero(np.diff(self.values) > tol) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(z)]):
            if b - a > 1 and np.abs(z[a : b - 1]).max() * norm > tol:
                v = z[a:b].copy()
                size = float(np.linalg.norm(v))
                last = -size if v[-1] > 0 else size
                v[-1] -= last
                part = self.basis[:, a:b]
                part -= np.outer(part @ v, v * (2 / (v @ v)))
                z[a:b] = 0
                z[b - 1] = last
        keep = np.abs(z) * norm > tol  # no share in u: the pair stays as it is
        d, z = self.values[keep], z[keep]
        if not len(d):
            return
        base, off = secular_roots(d, z * z)
        n = len(d)
        delta = (d - d[base][:, None]) - off[:, None]  # pole minus root
        # the shares in u that have just these roots: with them the vectors come out orthogonal
        gaps = d[:, None] - d
        under = np.vstack((gaps[1:], np.full((1, n), -1.0)))  # next pole minus pole, for roots from the pole's own on
        at = np.arange(n)
        den = np.where(at[:, None] < at[None, :], gaps, under)
        den[-1] = 1.0
        share = np.sqrt(np.prod(-delta / den, axis=0))
        turn = np.copysign(share, z) / delta
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
        self.basis[:, keep] = self.basis[:, keep] @ turn.T
        self.values[keep] = d[base] + off
        order = np.argsort(self.values, kind="stable")
        if not np.array_equal(order, np.arange(len(order))):
            self.values, self.basis = self.values[order], self.basis[:, order]

    def add(self, x: np.ndarray) -> None:
        """A vector more: the mean moves, the scatter grows by the centred outer product."""
        from_mean = x - self.mean
        self.n += 1
        self.mean = self.mean + from_mean / self.n
        if self.n > 1:
            self.rank_one(from_mean * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        """The scatter of both sets: the other's eigenpairs and the distance of the means as rank-one updates."""
        if not other.n:
            return
        if not self.n:
            self.mean, self.values, self.basis = other.mean, other.values.copy(), other.basis.copy()
        else:
            for value, u in zip(other.values, other.basis.T):
                if value > 0:
                    self.rank_one(u * np.sqrt(value))
            total = self.n + other.n
            apart = other.mean - self.mean
            self.rank_one(apart * np.sqrt(self.n * other.n / total))
            self.mean = self.mean + apart * (other.n / total)
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]

    def settle(self) -> None:
        """Make the columns orthonormal again after many updates."""
        q, r = np.linalg.qr(self.basis)
        self.basis = q * np.where(np.diag(r) < 0, -1.0, 1.0)
