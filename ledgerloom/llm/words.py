"""Vectorised words and word hashes of a text, for use inside Arrow batches.

A word is a run of bytes other than ASCII white space (space, \\t, \\n, \\v, \\f, \\r).  The 64-bit hash of a
word is a polynomial over its bytes (random byte values, an odd base), so that all words of a text are hashed by
prefix sums, and a multiply-shift finaliser.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _sequence(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and its inverse up to the longest text seen, at most ``KEEP`` kept between texts."""

    KEEP = 1 << 20
    size, up, down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.KEEP:
            return _sequence(_BASE, n), _sequence(_INVERSE, n)
        if n > cls.size:
            cls.size = max(1 << 12, 1 << (n - 1).bit_length())
            cls.up, cls.down = _sequence(_BASE, cls.size), _sequence(_INVERSE, cls.size)
        return cls.up, cls.down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    return _Powers.get(n)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S33)) * _MIX
        h = (h ^ (h >> _S33)) * _MIX2
        return h ^ (h >> _S33)


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte past the end of each word."""
    edge = np.ones(len(buf) + 2, bool)
    edge[1:-1] = SPACE[buf]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    return at[0::2], at[1::2]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each of the given byte ranges."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` word hashes; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * up[: len(h)], out=total[1:])
        return mix((total[k:] - total[:n]) * down[:n])


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of ``n`` positions, those within ``k`` places from any of the starts ``at``."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + k, -1)
    return np.cumsum(delta[:n]) > 0
