"""Vectorised words and word hashes over many texts at once.

A word is a run of bytes other than space and 0x09-0x0D. Its name is a 64-bit polynomial hash of its bytes under fixed
random byte values, mixed at the end, so equal words have equal names everywhere, without a dictionary.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _POWERS[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, document) of every word of the texts, in order; texts are joined by one space."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    begins = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=begins[1:])
    doc = np.searchsorted(begins, start, "right") - 1
    return data, start, end, doc


def byte_hashes(data: np.ndarray):
    """A function that hashes data[start:end] for arrays of starts and ends; equal bytes give equal hashes anywhere."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("up", _BASE, len(data))[: len(data)], out=total[1:])
    down = _powers("down", _INVERSE, len(data) + 1)

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (total[end] - total[start]) * down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    return of


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words in each text)."""
    data, start, end, doc = word_spans(texts, lower)
    counts = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), counts
    return byte_hashes(data)(start, end), counts


def window_hashes(words: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of every run of width consecutive words (over the whole array; callers drop those that cross texts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = mix(words + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * _powers("up", _BASE, len(w))[: len(w)], out=total[1:])
    return mix((total[width:] - total[:n]) * _powers("down", _INVERSE, len(w))[:n])


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of each run words[start:end]; equal to window_hashes for runs of that width."""
    w = mix(words + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * _powers("up", _BASE, max(1, len(w)))[: len(w)], out=total[1:])
    return mix((total[end] - total[start]) * _powers("down", _INVERSE, len(w) + 1)[start])
