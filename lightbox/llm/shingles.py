"""Word shingles as 64-bit hashes, for whole chunks of texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
# The multiplier of the rolling hash (odd, so it has an inverse modulo 2^64) and mixing constants.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(n, U(base), dtype=np.uint64)
        p[0] = U(1)
        out.append(np.cumprod(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    a, b = _powers(size)
    return a[:n], b[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z lower-cased, split at ASCII white space) of ``data``, and where it starts."""
    b = LOWERED[np.frombuffer(data, dtype=np.uint8)]
    inside = ~IS_SPACE[b]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + U(1)) * up[:-1], out=sums[1:])
    own = (sums[ends] - sums[starts]) * down[starts]
    return mix(own + (ends - starts).astype(np.uint64) * STEP), starts


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles of ``size`` words as sorted hashes; a text with fewer words
    has its whole sequence as the only one, a text without words none."""
    parts = [t.encode() for t in texts]
    words, starts = word_hashes(b"\n".join(parts))
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    bounds = np.searchsorted(starts, offsets).tolist()
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        rolled = rolled * STEP + words[k : k + n]
    rolled = mix(rolled + U(size))
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= size:
            found = np.sort(rolled[a : b - size + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif b > a:
            h = U(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * STEP + w
                out.append(mix(np.array([h + U(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
