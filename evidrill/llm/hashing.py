"""Vectorized hashing of bytes and words: prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer text is a block of its own.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = np.array(x, _U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_powers = np.ones(1, _U), np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + (1 << 16))
        up, down = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span of ``data`` (bytes) follows."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def windows(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all spans of length ``k``, unmixed."""
    n = len(sums) - k
    return (sums[k:] - sums[:n]) * powers(len(sums))[1][:n] if n > 0 else np.zeros(0, _U)


def blocks(rows: list, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts (bytes) of about ``size`` bytes together."""
    a, total = 0, 0
    for i, t in enumerate(rows):
        if i > a and total + len(t) > size:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(rows):
        yield a, len(rows)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``texts`` (A-Z lower-cased, split at ASCII blanks) and the bounds of each text's words."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    blank = _BLANK[data]
    before = np.empty_like(blank)
    before[0], before[1:] = True, blank[:-1]
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    hashes = spans(prefix(data), start, end)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(start, np.concatenate([[0], ends]))


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``k`` words; of the whole sequence if it is shorter; none if it is empty."""
    n = len(word)
    if n == 0:
        return np.zeros(0, _U)
    m = min(k, n)
    out = np.zeros(n - m + 1, _U)
    for i in range(m):
        out = out * _U(0xD6E8FEB86659FD93) + word[i : n - m + 1 + i]
    return np.unique(mix(out + _U(m if m < k else 0)))
