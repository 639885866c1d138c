"""Generators of many seeds, without the cost of a new one for each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# numpy's documented, fixed way from a seed to the start of PCG64: a pool of four words, hashed and mixed, then drawn out.
POOL, HASH, DRAW, MIX = 4, (0x43B0D7E5, 0x931E8875), (0x8B51F9DD, 0x58F38DED), (0xCA01F9DD, 0x4973F715)
STEP, WIDE = 0x2360ED051FC65DA44385DF649FCCF645, (1 << 128) - 1
SHIFT = np.uint32(16)


def hashed(start: int, factor: int):
    """A function that hashes words with a constant that moves on at each call."""
    at = start

    def of(x: np.ndarray) -> np.ndarray:
        nonlocal at
        x = x ^ np.uint32(at)
        at = at * factor & 0xFFFFFFFF
        x *= np.uint32(at)
        return x ^ x >> SHIFT

    return of


def starts(seeds: Iterable[int]) -> np.ndarray:
    """SeedSequence(seed).generate_state(4, uint64) of each seed from 0 to 2**64 - 1: (seed, 4)."""
    seeds = np.fromiter(seeds, np.uint64)
    words = [(seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32)]
    step = hashed(*HASH)
    pool = [step(w) for w in words + [np.zeros(len(seeds), np.uint32)] * (POOL - 2)]
    for i in range(POOL):
        for j in range(POOL):
            if i != j:
                x = np.uint32(MIX[0]) * pool[j] - np.uint32(MIX[1]) * step(pool[i])
                pool[j] = x ^ x >> SHIFT
    step = hashed(*DRAW)
    out = [step(pool[i % POOL]).astype(np.uint64) for i in range(2 * POOL)]
    return np.stack([out[2 * i] | out[2 * i + 1] << np.uint64(32) for i in range(POOL)], axis=1)


def generators(seeds: Iterable[int]) -> Iterator[np.random.Generator]:
    """One generator, for each seed in turn in the state of default_rng(seed)."""
    bits = np.random.PCG64(0)
    rng = np.random.Generator(bits)
    for a, b, c, d in starts(seeds).tolist():
        inc = (c << 65 | d << 1 | 1) & WIDE
        bits.state = {"bit_generator": "PCG64", "state": {"state": ((a << 64 | b) + inc) * STEP + inc & WIDE, "inc": inc}, "has_uint32": 0, "uinteger": 0}
        yield rng
