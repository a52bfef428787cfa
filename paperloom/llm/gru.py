"""A gated recurrent language model with a class-factored softmax, in numpy: training by truncated backpropagation, scoring."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from paperloom.llm.words import spread

F32 = np.float32
NAMES = ("wx", "wh", "wc", "bc", "wo", "bo")
COLUMNS = 512  # texts that a window of the training holds side by side


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= F32(0.5)
    np.tanh(x, out=x)
    x *= F32(0.5)
    x += F32(0.5)
    return x


def exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """In place: exponentials, their sum by rows, and what a row was lowered by; rows within the range of floats stay as they are."""
    top = 0.0
    if not (x.max() < 60 and x.min() > -60):
        top = x.max(axis=1, keepdims=True)
        x -= top
        top = top[:, 0]
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), top


def by_value(x: np.ndarray, n: int) -> np.ndarray:
    """Stable order of numbers below ``n``; short integers are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if n <= 1 << 16 else x, kind="stable")


@dataclass
class Gru:
    """Symbols are numbered by class: symbol s is member ``s % members`` of class ``s // members``; symbol 0 ends a text."""

    wx: np.ndarray  # symbol -> inputs of the gates and of the candidate
    wh: np.ndarray
    wc: np.ndarray  # classes
    bc: np.ndarray
    wo: np.ndarray  # members
    bo: np.ndarray

    @property
    def members(self) -> int:
        return len(self.bo) // len(self.bc)

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the inputs and of the state, gate by gate."""
        k = self.wh.shape[0]
        wx, wh = (np.ascontiguousarray(w.reshape(-1, 3, k).transpose(1, 0, 2)) for w in (self.wx, self.wh))
        return wx, wh

    def step(self, x: np.ndarray, h: np.ndarray):
        wx, wh = self.gates()
        out, gx = np.empty_like(h), wx[:, x]
        self.move(gx, wh, h, out)
        return (out,)

    @staticmethod
    def move(g: np.ndarray, wh: np.ndarray, h: np.ndarray, out: np.ndarray) -> np.ndarray:
        """One step of the state from ``h`` to ``out``. ``g`` has the inputs of both gates and of the candidate and takes their
        values; returns the candidate's share of the state."""
        gh = np.matmul(h, wh)
        g[:2] += gh[:2]
        z, r = sigmoid(g[:2])
        n = g[2]
        np.multiply(r, gh[2], out=out)
        n += out
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= z
        out += n
        return gh[2]

    def by_class(self, h: np.ndarray, y: np.ndarray):
        """Rows in the order of their targets' classes, a one behind each; logits of the classes and of the members."""
        m, n, k = self.members, len(self.bc), h.shape[1]
        cls = y // m
        order = by_value(cls, n)
        cls, own = cls[order], y[order] % m
        edge = np.searchsorted(cls, np.arange(n + 1))
        some = np.flatnonzero(np.diff(edge)).tolist()
        rows = np.empty((len(y), k + 1), h.dtype)
        np.take(h, order, axis=0, out=rows[:, :k])
        rows[:, k] = 1
        p = rows @ np.vstack((self.wc, self.bc))
        w = np.concatenate((self.wo, self.bo[:, None]), axis=1)
        wt, q = w.reshape(n, m, k + 1).transpose(0, 2, 1), np.empty((len(y), m), h.dtype)
        parts = [(c, slice(*edge[c : c + 2].tolist())) for c in some]
        for c, part in parts:
            np.matmul(rows[part], wt[c], out=q[part])
        return order, cls, own, parts, rows, p, q, w

    def logs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol."""
        order, cls, own, _, _, p, q, _ = self.by_class(h, y)
        at, total = np.arange(len(y)), 0.0
        for x, where in ((p, cls), (q, own)):
            picked = x[at, where]
            _, s, top = exps(x)
            total = total + np.maximum(picked - np.log(s) - top, F32(np.log(1e-30)))
        out = np.empty_like(total)
        out[order] = total
        return out

    def loss(self, h: np.ndarray, y: np.ndarray):
        """Gradients of the mean loss: of the states, and of the weights of classes and members."""
        order, cls, own, parts, rows, p, q, w = self.by_class(h, y)
        at, m, k = np.arange(len(y)), self.members, h.shape[1]
        scale = h.dtype.type(1 / len(y))
        for x, where in ((p, cls), (q, own)):
            _, s, _ = exps(x)
            x *= (scale / s)[:, None]
            x[at, where] -= scale
        gc, gw = rows.T @ p, np.zeros_like(w)
        back = np.empty_like(rows)
        for c, part in parts:
            of = slice(c * m, (c + 1) * m)
            np.matmul(q[part], w[of], out=back[part])
            np.matmul(q[part].T, rows[part], out=gw[of])
        d = p @ self.wc.T
        d += back[:, :k]
        dh = np.empty_like(d)
        dh[order] = d
        return dh, {"wc": gc[:k], "bc": gc[k], "wo": gw[:, :k], "bo": gw[:, k]}

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray):
        """One truncated window of shape (steps, streams): loss gradients and the state that the next window takes over."""
        (steps, streams), k = x.shape, h.shape[1]
        wx, wh = self.gates()
        g = np.take(wx, x.ravel(), axis=1).reshape(3, steps, streams, k)  # both gates and the candidate
        keep = (~fresh).astype(h.dtype)[:, :, None]
        was, states, ghn = (np.empty((steps, streams, k), h.dtype) for _ in range(3))
        for t in range(steps):
            np.multiply(h, keep[t], out=was[t])
            ghn[t] = self.move(g[:, t], wh, was[t], states[t])
            h = states[t]
        at = np.flatnonzero(live.ravel())
        if not len(at):
            return None, h
        flat = states.reshape(-1, k)
        full = len(at) == len(flat)
        dh, grads = self.loss(flat if full else flat[at], y.ravel() if full else y.ravel()[at])
        if not full:
            part, dh = dh, np.zeros_like(flat)
            dh[at] = part
        dout = dh.reshape(steps, streams, k)
        z, r, n = g
        # what a change of the state moves: the candidate, its share of the state, both gates
        d = np.empty((4, steps, streams, k), h.dtype)
        by_z, by_r, by_g, by_n = d
        np.multiply(n, n, out=by_n)
        np.subtract(1, by_n, out=by_n)
        was_n = np.subtract(was, n)
        nz = np.subtract(1, z)
        by_n *= nz
        np.multiply(was_n, z, out=by_z)
        by_z *= nz
        np.subtract(1, r, out=nz)
        np.multiply(ghn, r, out=by_r)
        by_r *= nz
        back, turned = np.zeros_like(h), np.ascontiguousarray(wh.transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            back += dout[t]
            by_n[t] *= back
            by_z[t] *= back
            by_r[t] *= by_n[t]
            np.multiply(by_n[t], r[t], out=by_g[t])
            back *= z[t]
            for part in np.matmul(d[:3, t], turned):
                back += part
            back *= keep[t]
        gh = np.matmul(was.reshape(-1, k).T, d[:3].reshape(3, -1, k))
        grads["wh"] = gh.transpose(1, 0, 2).reshape(k, 3 * k)
        grads["wx"] = np.zeros_like(self.wx)
        order = by_value(x.ravel(), len(self.wx))
        own = x.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows = np.empty((len(order), 3, k), h.dtype)
        for i, j in enumerate((0, 1, 3)):
            rows[:, i] = d[j].reshape(-1, k)[order]
        grads["wx"][own[first]] = np.add.reduceat(rows.reshape(-1, 3 * k), first, axis=0)
        return grads, h

    def packed(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in NAMES]).astype(F32)

    def unpacked(self, flat: np.ndarray) -> Gru:
        out, at = [], 0
        for n in NAMES:
            a = getattr(self, n)
            out.append(flat[at : at + a.size].reshape(a.shape).astype(F32))
            at += a.size
        return Gru(*out)


def initial(log_share: np.ndarray, members: int, hidden: int, seed: int = 3) -> Gru:
    """Small random weights; the biases give each symbol its share among all, so training starts from the unigram model."""
    r = np.random.default_rng(seed)
    n = len(log_share)
    by_class = log_share.reshape(-1, members)
    return Gru(r.normal(0, 0.3, (n, 3 * hidden)).astype(F32), r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(F32), np.zeros((hidden, n // members), F32),
               np.log(np.exp(by_class).sum(axis=1)).astype(F32), np.zeros((n, hidden), F32), log_share.astype(F32))


class Streams:
    """Texts laid into at most ``most`` columns, one after the other in each, the columns about equally long, the longest first.

    Symbols stand column by column in one flat array with a start for each column, so memory follows the symbols: a long
    text beside many short ones makes one long column, not a long table.
    """

    def __init__(self, lengths: np.ndarray, most: int):
        k = max(1, min(most, len(lengths)))
        heap = [(0, s) for s in range(k)]
        col = np.zeros(len(lengths), np.int64)
        for d in np.argsort(-lengths, kind="stable").tolist():
            load, s = heapq.heappop(heap)
            col[d] = s
            heapq.heappush(heap, (load + int(lengths[d]), s))
        loads = np.array([n for n, _ in sorted(heap, key=lambda x: x[1])])
        order = np.argsort(-loads, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        self.loads = loads[order]
        self.starts = np.cumsum(self.loads) - self.loads
        texts = np.lexsort((-lengths, place[col]))  # by column, the longest text first
        first = np.cumsum(lengths) - lengths
        self.places = spread(first[texts], lengths[texts])  # where each flat symbol stands in the texts
        ends = np.cumsum(lengths[texts])
        self.heads = ends - lengths[texts]

    def fill(self, symbols: np.ndarray) -> None:
        """Targets, inputs and where a text begins, flat."""
        self.y = symbols[self.places].astype(np.int32)
        self.fresh = np.zeros(len(self.y), bool)
        self.fresh[self.heads[self.heads < len(self.y)]] = True
        self.x = np.zeros_like(self.y)
        self.x[1:] = self.y[:-1]
        self.x[self.fresh] = 0

    def live(self, t: int) -> int:
        """How many columns are longer than ``t``: the first ones."""
        return int(np.searchsorted(-self.loads, -t, side="left"))


def score(net: Gru, symbols: np.ndarray, lengths: np.ndarray, most: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log probability of every symbol, in the order given. The state runs through the whole text."""
    if not len(symbols):
        return np.zeros(0)
    lay = Streams(lengths, most)
    lay.fill(symbols)
    k, (wx, wh) = net.wh.shape[0], net.gates()
    h, out, end = np.zeros((len(lay.loads), k), F32), np.zeros(len(symbols)), int(lay.loads[0])
    a = 0
    while a < end:
        # thin stretches take more steps at once, about as many rows as a full one
        stop = min(a + max(steps, most * steps // lay.live(a)), end)
        live = np.searchsorted(-lay.loads, -np.arange(a, stop), side="left")
        at = np.concatenate([lay.starts[:n] + t for t, n in zip(range(a, stop), live.tolist())])
        g, keep = np.take(wx, lay.x[at], axis=1), (~lay.fresh[at]).astype(F32)[:, None]
        states, p = np.empty((len(at), k), F32), 0
        for n in live.tolist():
            rows = slice(p, p + n)
            net.move(g[:, rows], wh, h[:n] * keep[rows], states[rows])
            h, p = states[rows], p + n
        out[lay.places[at]] = net.logs(states, lay.y[at])
        a = stop
    return out


class Adam:
    """The weights of ``net`` become views of one array, which is moved in blocks that stay in the cache."""

    def __init__(self, net: Gru, rate: float, block: int = 1 << 15):
        self.rate, self.block, self.n, self.w = rate, block, 0, net.packed()
        at = 0
        for k in NAMES:
            a = getattr(net, k)
            setattr(net, k, self.w[at : at + a.size].reshape(a.shape))
            at += a.size
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def apply(self, g: dict, share: float = 1.0) -> None:
        """One step; ``share`` of its size, where the gradient comes from so much of a full window. ``m`` and ``v`` are kept as
        10 and 100 times the means, so that a gradient is added as it is."""
        self.n += 1
        flat = np.concatenate([g[k].ravel() for k in NAMES])
        cut = F32(min(1.0, 1.0 / max(float(np.vdot(flat, flat)) ** 0.5, 1e-9)))
        full = (1 - 0.99**self.n) ** -0.5 / 10  # of the root of v
        rate, least = F32(share * self.rate / (1 - 0.9**self.n) / 10 / full), F32(1e-6 / full)
        for a in range(0, len(flat), self.block):
            x, m, v = (y[a : a + self.block] for y in (flat, self.m, self.v))
            x *= cut
            x += F32(1e-18)  # far below what moves a weight: means that fade out do not become subnormal, which is slow
            m *= F32(0.9)
            m += x
            x *= x
            v *= F32(0.99)
            v += x
            np.sqrt(v, out=x)
            x += least
            np.divide(m, x, out=x)
            x *= rate
            self.w[a : a + self.block] -= x


def train(net: Gru, adam: Adam, symbols: np.ndarray, lengths: np.ndarray, most: int = COLUMNS, steps: int = 16) -> None:
    """One pass over the texts: windows of ``steps`` symbols, the state carried from window to window, gradients cut there.

    A step counts by the share of a window with all columns that it saw, so the thin windows at the end of the longest columns
    move the network by as little as they hold.
    """
    if not len(symbols):
        return
    lay = Streams(lengths, most)
    lay.fill(symbols)
    h = np.zeros((len(lay.loads), net.wh.shape[0]), F32)
    for a in range(0, int(lay.loads[0]), steps):
        k = lay.live(a)
        t = np.arange(a, min(a + steps, int(lay.loads[0])))[:, None]
        live = t < lay.loads[:k]
        at = np.where(live, lay.starts[:k] + t, 0)
        x, y, fresh = (np.where(live, v[at], 0) for v in (lay.x, lay.y, lay.fresh))
        g, h = net.window(x.astype(np.int64), y.astype(np.int64), fresh.astype(bool), live, h[:k])
        if g:
            adam.apply(g, float(live.sum()) / (len(lay.loads) * steps))
