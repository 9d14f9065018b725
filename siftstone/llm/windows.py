"""Anchored windows: the shared arithmetic of the exact repeat finders.

A *window* is `size` consecutive symbols of one document.  Every window picks
one *anchor*: the leftmost smallest gram of `gram` symbols inside it, by a
mixed 64-bit hash.  The choice depends on the window's own symbols alone, so
equal windows pick the same gram at the same place, wherever they stand.
Windows that pick the same anchor form a *run* of consecutive starts; about
one position in (size - gram + 2) / 2 is an anchor.  Comparing runs instead of
windows divides what has to be shuffled by that factor and loses no window.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads the bits of polynomial hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any stretch of a symbol array in O(1) each, modulo 2**64."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(symbols)
        self._up = _powers(base, n)
        self._down = _powers(pow(base, -1, 1 << 64), n)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self._up[:n], out=self._sum[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self._sum[stop] - self._sum[start]) * self._down[start]

    def every(self, length: int) -> np.ndarray:
        n = len(self._sum) - length
        return (self._sum[length:] - self._sum[:n]) * self._down[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of `width` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def runs(rolling: Rolling, n: int, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor, anchor's hash) of every run of windows.

    Ties go to the leftmost gram: the low bits of the order carry the position's
    rank only through equality, so equal hashes are split by a forward scan.
    """
    if n < size:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    h = mix(rolling.every(gram))
    width = size - gram + 1
    low = sliding_min(h, width)
    starts = np.arange(n - size + 1)
    # Where each value of `low` next occurs at or after a start: the leftmost minimum.
    new = np.empty(len(low), bool)
    new[0] = True
    # A start keeps its predecessor's anchor if that anchor is still inside and still minimal.
    enters = h[width - 1 :][: len(low)] < np.concatenate(([np.uint64(_MASK)], low[:-1]))
    leaves = np.concatenate(([True], h[: len(low) - 1] == low[:-1]))
    new = enters | leaves
    at = np.flatnonzero(new)
    # Only at these starts may the anchor change; find it by comparing the window's grams.
    pos = at.copy()
    look = np.lib.stride_tricks.sliding_window_view(h, width)
    pos = at + np.argmax(look[at] == low[at][:, None], axis=1)
    keep = np.concatenate(([True], pos[1:] != pos[:-1]))
    at, pos = at[keep], pos[keep]
    last = np.concatenate((at[1:] - 1, [starts[-1]]))
    return at, last, pos, h[pos]
