"""Simple-8b: a 4-bit selector and up to 60 values in each 64-bit word; values of more than 60 bits are kept aside as escapes."""

from __future__ import annotations

import numpy as np

#: How many values of how many bits a word holds, by selector from 1. Selector 0: the payload is an escape's number.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


#: Bits of each 16-bit value.
SHORT = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.uint8)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    v = values.astype(np.uint64)
    out = np.zeros(len(v), dtype=np.uint8)
    for shift in (48, 32, 16):
        part = (v >> np.uint64(shift)).astype(np.uint16)
        out = np.where((out == 0) & (part > 0), SHORT[part] + np.uint8(shift), out) if part.any() else out
    return np.where(out == 0, SHORT[v.astype(np.uint16)], out)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes. Each word takes the most values that fit, in order; the last may hold fewer than its selector says."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    v = np.concatenate((values.astype(np.uint64), np.zeros(64, np.uint64)))
    w = np.concatenate((widths(values), np.zeros(64, np.uint8)))
    big = w > 60
    peak = {1: w}
    for p in (1, 2, 4, 8, 16):
        peak[2 * p] = np.maximum(peak[p], np.concatenate((peak[p][p:], np.zeros(p, np.uint8))))
    step, sel = np.ones(len(w), np.uint8), np.full(len(w), 14, np.uint8)
    for k in range(12, -1, -1):
        count, bits = SELECTORS[k]
        p = 1 << (count.bit_length() - 1)
        most = peak[p] if p == count else np.maximum(peak[p], np.concatenate((peak[p][count - p :], np.zeros(count - p, np.uint8))))
        fits = most <= bits
        step[fits], sel[fits] = count, k + 1
    sel[big] = 0
    at, jump, starts = 0, step.tolist(), []
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts)
    kind = sel[starts]
    words = kind.astype(np.uint64) << np.uint64(60)
    for k, (count, bits) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[rows] |= np.bitwise_or.reduce(v[starts[rows][:, None] + np.arange(count)] << shift, axis=1)
    rows = np.flatnonzero(kind == 0)
    words[rows] = np.arange(len(rows), dtype=np.uint64)
    return words, v[starts[rows]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    size = np.array([1] + [c for c, _ in SELECTORS] + [0])[kind]
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()) + 1, np.uint64)
    for k, (count, bits) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[first[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shift) & np.uint64((1 << bits) - 1)
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        out[first[rows]] = escapes[words[rows].astype(np.int64)]
    return out[:n]
