"""Word shingles as sets of 64-bit hashes, vectorised over a text's bytes; for use inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, U), np.ones(1, U)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2**64, for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U(base), U)
            p[0] = U(1)
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ of some bytes begin and end."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(gap.astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def lowered(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_hashes(data: np.ndarray) -> np.ndarray:
    begin, end = words(data)
    p, inverse = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * p[: len(data)], dtype=U)])
    return mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U))


def shingle_set(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; with fewer words, of all of them."""
    if not len(hashes):
        return np.zeros(0, U)
    k = min(n, len(hashes))
    out = np.full(len(hashes) - k + 1, U(k), U)
    for i in range(k):
        out = out * U(0xD6E8FEB86659FD93) + hashes[i : i + len(out)]
    return np.unique(mixed(out))


def sequence_key(hashes: np.ndarray) -> bytes:
    """128 bits of the whole word sequence."""
    p, _ = powers(len(hashes) + 1)
    a = np.sum(hashes * p[: len(hashes)], dtype=U)
    b = np.sum(mixed(hashes ^ U(0x5851F42D4C957F2D)) * p[: len(hashes)][::-1], dtype=U)
    return mixed(np.array([a, b], U) + U(len(hashes))).tobytes()
