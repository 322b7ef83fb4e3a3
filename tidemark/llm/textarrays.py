"""Texts as numpy arrays: code points or bytes, runs, polynomial hashes of spans (modulo 2**64)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
KEPT = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64; grown by doubling and kept up to KEPT of them."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(10, int(n).bit_length())
        have = np.empty(size + 1, _U)
        have[0], have[1], filled = 1, base, 2
        while filled <= size:
            take = min(filled, size + 1 - filled)
            have[filled : filled + take] = have[:take] * _U(pow(base, filled, 1 << 64))
            filled += take
        if size <= KEPT:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P of len(values) + 1 with P[b] - P[a] the hash of values[a:b] times BASE ** a."""
    n = len(values)
    out = np.zeros(n + 1, _U)
    np.cumsum(mix(values.astype(_U) + _U(1)) * powers(_BASE, n)[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled hashes of values[start:end], equal for equal spans at any place."""
    inv = powers(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(_U))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each text starts (with the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def ascii_lower_points(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + 32, points).astype(points.dtype)


def is_space(values: np.ndarray) -> np.ndarray:
    """The six characters that separate words: 0x20 and 0x09-0x0D."""
    return (values == 32) | ((values >= 9) & (values <= 13))


def words(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each run without separators; runs end at the bounds of texts."""
    n = len(values)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~is_space(values)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = bounds[:-1][bounds[:-1] < n]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = bounds[1:][bounds[1:] > 0] - 1
    last[ends] = solid[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1
