"""Hashes of words and of runs of words, by array arithmetic over a text's bytes."""

from __future__ import annotations

import numpy as np

_SEED = 0x5EED
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _tables() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _tables()
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse modulo 2**64, up to n; made longer as texts need."""
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 2 * len(have), 1 << 12)
        step = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(size, step, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word: bytes between space, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased.

    A word's hash is the difference of two prefix sums of byte codes times powers of an odd number,
    divided by the power at its start, then mixed: equal words have equal hashes wherever they stand."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", len(data))[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(_BASE) + words[i : n - size + 1 + i])
    return np.unique(out)
