"""Words and word shingles of whole texts as 64-bit numbers, for a batch of texts at a time.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, after A-Z became a-z.
UTF-8 never uses those bytes inside another character, so bytes and code points agree.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEED = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2^64 for ``i`` below ``n``."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(_BLOCK)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """One number per word of one text, in order."""
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    space = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(data)
        if n <= _BLOCK:
            up, down = _UP[:n], _DOWN
        else:  # long texts: powers of whole blocks times powers inside a block
            jump = _UP[-1] * _BASE
            back = np.uint64(pow(int(jump), -1, 1 << 64))
            blocks = -(-n // _BLOCK)
            far, near = np.full(blocks, jump), np.full(blocks, back)
            far[0] = near[0] = 1
            far, near = np.multiply.accumulate(far), np.multiply.accumulate(near)
            up = (far[:, None] * _UP[None, :]).ravel()[:n]
            down = (near[:, None] * _DOWN[None, :]).ravel()
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        value = (sums[end] - sums[start]) * down[start]
        return mix(value + _SEED * (end - start).astype(np.uint64))


def shingle_set(raw: bytes | None, width: int = 2) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, a text without words has none."""
    words = word_hashes(raw) if raw else np.empty(0, np.uint64)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        n = max(1, len(words) - width + 1)
        total = np.full(n, np.uint64(min(width, len(words))))
        for k in range(min(width, len(words))):
            total = mix(total * _BASE + words[k:k + n])
    return np.unique(total)
