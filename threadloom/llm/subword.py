"""Hashed subword features and the averaged-embedding softmax model behind the quality and toxicity operators.

Model: every hashed feature has a learned vector; a bag of features is the
average of its vectors; a linear layer and a softmax give the class.  Because
averaging and the linear layer commute, scoring needs one number per feature
(the class-logit difference of its vector), which is what is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadloom.llm import textcore as tc

_U = np.uint64
_SPACE = np.arange(256) <= 32
_MUL = _U(0x9E3779B97F4A7C15)


def padded(arr: pa.Array, lower: bool, words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a piece with one space before, between and after documents; white space (or all non-word bytes) becomes a space.

    Returns the bytes and each document's offset in them (length n + 1).
    """
    b, off = tc.raw(pc.utf8_lower(arr) if lower else arr)
    seps = off + np.arange(len(off))
    out = np.empty(len(b) + len(off), dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[seps] = False
    out[seps] = 32
    out[keep] = b
    out[~tc._IS_WORD[out] if words_only else _SPACE[out]] = 32
    return out, seps


def tokens(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run without spaces."""
    s = b == 32
    return np.flatnonzero(s[:-1] & ~s[1:]) + 1, np.flatnonzero(~s[:-1] & s[1:]) + 1


def gram_buckets(b: np.ndarray, orders: tuple[int, ...], bits: int):
    """Per order: (positions, buckets) of the byte n-grams that hold a space at most at either end."""
    space = b == 32
    n = len(b)
    code = b.astype(np.uint64)
    inner = np.zeros(n, dtype=bool)
    for k in range(2, max(orders) + 1):
        if n < k:
            return
        m = n - k + 1
        code = code[:m] | (b[k - 1 :].astype(np.uint64) << _U(8 * (k - 1)))
        if k > 2:
            inner = inner[:m] | space[k - 2 : k - 2 + m]
        else:
            inner = inner[:m]
        if k in orders:
            ok = ~inner & ~(space[:m] & space[k - 1 :])
            pos = np.flatnonzero(ok)
            h = (code[pos] + _U(k)) * _MUL
            h ^= h >> _U(29)
            h *= _U(0xBF58476D1CE4E5B9)
            yield pos, (h >> _U(64 - bits)).astype(np.int64)


class BagModel:
    """Feature vectors ``E`` (2**bits x dim) with a binary softmax layer ``W``, ``c``; trained example by example."""

    def __init__(self, bits: int, dim: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.E = rng.uniform(-1 / dim, 1 / dim, size=(1 << bits, dim)).astype(np.float32)
        self.W = np.zeros((2, dim), dtype=np.float32)
        self.c = np.zeros(2, dtype=np.float32)

    def step(self, idx: np.ndarray, x: np.ndarray, y: int, rate: float) -> None:
        """One stochastic gradient step; ``idx`` has distinct features and ``x`` sums to 1."""
        rows = self.E[idx]
        h = x @ rows
        z = self.W @ h + self.c
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = p @ self.W
        self.W -= rate * np.outer(p, h)
        self.c -= rate * 0.1 * p
        # Mean pooling divides a feature's gradient by the bag size; ||x||^2 undoes it, so long and short bags learn alike.
        self.E[idx] = rows - (rate / float(x @ x)) * np.outer(x, back)

    def folded(self) -> tuple[np.ndarray, float]:
        """Logit difference (class 1 less class 0) of each feature, and of the bias."""
        return self.E @ (self.W[1] - self.W[0]), float(self.c[1] - self.c[0])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))
