"""Vectorised word hashing of a block of texts."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# every ASCII character but letters and digits separates
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[str], at_marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the bounds: the words of
    text i are ``hashes[bounds[i]:bounds[i + 1]]``. Words are what stands between
    ASCII white space, or ``at_marks`` between ASCII characters that are neither
    letters nor digits."""
    gaps = _MARKS if at_marks else _SPACE
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded), dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in coded), dtype=np.int64, count=len(texts))
    ends_of_text = np.cumsum(lengths)
    space = np.concatenate([[True], gaps[data], [True]])
    starts = np.flatnonzero(space[:-2] & ~space[1:-1])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of_text - 1, side="left")]) if len(texts) else np.zeros(1, dtype=np.int64)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTER[data] * up[: len(data)])])
    return mix((sums[ends] - sums[starts]) * down[starts]), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word position of every shingle of ``size`` words; a text with
    fewer words, but some, has the one shingle of all its words."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) - bounds[:-1][text]
    width = np.minimum(size, n)[text]
    first = at + width <= n[text]
    first &= (n[text] >= size) | (at == 0)
    start = np.flatnonzero(first)
    h = np.zeros(len(start), dtype=np.uint64)
    for k in range(size):
        there = width[start] > k
        step = mix(h * np.uint64(0x100000001B3) + words[np.minimum(start + k, max(len(words) - 1, 0))] + np.uint64(k + 1)) if len(words) else h
        h = np.where(there, step, h)
    return h, text[start], at[start]
