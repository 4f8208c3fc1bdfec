"""64-bit hashes of words and shingles, computed in numpy over whole blocks of text."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20_231)
#: One odd 64-bit number a byte; white space counts 0 and A-Z as a-z.
BYTE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
BYTE_CASED = BYTE.copy()
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE[SPACE] = BYTE_CASED[SPACE] = 0
STEP = _rng.integers(1, 2**63, 16, dtype=U) * U(2) + U(1)
_powers = [np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, U))]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    if len(_powers[0]) < n:
        _powers[0] = np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15, U))
    return _powers[0]


def word_hashes(texts: list[str], cased: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts in order, and where each text's words begin (one more than texts)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    if not len(data):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    gap = SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    at = np.arange(len(data))
    at -= np.maximum.accumulate(np.where(first, at, 0))
    code = (BYTE_CASED if cased else BYTE)[data]
    code *= powers(int(at.max()) + 1)[at]
    hashes = mix(np.add.reduceat(code, starts))
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; of its whole sequence if it has fewer."""
    words, bounds = word_hashes(texts)
    runs = np.empty(0, U)
    if len(words) >= width:
        runs = words[: len(words) - width + 1] * STEP[0]
        for k in range(1, width):
            runs = mix(runs) + words[k : len(words) - width + 1 + k] * STEP[k]
        runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, U)
            for w in words[a:b]:
                h = mix(h * STEP[15] + w)
            out.append(h)
        else:
            out.append(np.empty(0, U))
    return out
