"""Hashed word shingles and minhash minima of whole texts, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: One odd multiplier, and a random word for each byte value.
BASE = _U(int(_rng.integers(1 << 62)) * 2 + 1)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, for at least n exponents."""
    if len(_powers["up"]) < n:
        m = max(n, 1 << 16)
        inverse = _U(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(text: str | None) -> list[bytes]:
    """Words of a whole text, A to Z in lower case; bytes.split() splits at exactly the white space meant."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of ``size`` words, sorted; fewer words: the whole sequence; none: empty."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(w), np.uint8)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, len(w))
    up, down = _grown(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * up[: len(raw)], out=sums[1:])
        a, b = starts[: len(w) - k + 1], ends[k - 1 :]
        return np.unique(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))


class Permutations:
    """Minima of a set under ``count`` hash functions: multiply, add and keep the high half of a 64-bit word."""

    def __init__(self, count: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.multiply = rng.integers(0, 1 << 63, count, dtype=np.uint64) * _U(2) + _U(1)
        self.add = rng.integers(0, 1 << 63, count, dtype=np.uint64)

    def minima(self, hashes: np.ndarray, block: int = 1 << 9) -> np.ndarray:
        low = np.full(len(self.add), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(hashes), block):
                part = hashes[i : i + block]
                np.minimum(low, (part[None, :] * self.multiply[:, None] + self.add[:, None]).min(axis=1), out=low)
        return mixed(low)
