"""Words of many texts at once, on UTF-8 bytes, with 64-bit hashes of words and word n-grams.

All separators of the word rules used here are ASCII, so a byte never belongs to half a separator and
byte tables give the same words as the regular expressions.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)


def byte_table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE = byte_table([0x20, *range(0x09, 0x0E)])
NOT_SPACE = ~SPACE
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (shifts and odd multipliers)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * _MULT)
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums from which the hash of any byte range follows."""
    out = np.zeros(len(data) + 1, U64)
    if len(data):
        np.cumsum(BYTE_CODE[data] * _powers(_BASE, len(data)), out=out[1:], dtype=U64)
    return out


def range_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inv = _powers(_INV, len(pre))
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(U64) * _MULT)


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that stay inside a text: starts, ends, text numbers."""
    n = len(flag)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    edge = off[:-1]
    before[edge[edge < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(flag & ~before)
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs inside a text, and the number of the first word of each."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        acc = mix(acc * _MULT + h[k : len(h) - n + 1 + k])
    at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
    return acc[at], at


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def per_text(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)
