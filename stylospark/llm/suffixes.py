"""Sorted suffixes of a bounded set of strings, in numpy."""

from __future__ import annotations

import numpy as np


def lay_out(tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings one after another, each with a sentinel of its own that is below
    all tokens: (symbols, start of each string)."""
    m, size = len(offs) - 1, np.diff(offs)
    start = np.cumsum(size + 1) - size - 1
    out = np.empty(len(tokens) + m, np.int64)
    out[start + size] = np.arange(m)
    body = np.ones(len(out), bool)
    body[start + size] = False
    out[body] = tokens + m
    return out, start


def doubled(sym: np.ndarray, reach: int) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... `reach` symbols."""
    n = len(sym)
    levels = [np.unique(sym, return_inverse=True)[1].astype(np.int64)]
    k = 1
    while k < reach:
        r = levels[-1]
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = r[k:] + 1
        levels.append(np.unique(r * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64))
        k *= 2
    return levels


def longest(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of positions a and b; their sentinels differ and end it."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        out += (levels[k][i] == levels[k][j]).astype(np.int64) << k
    return out
