"""Word hashes and hashes of word runs, as numpy arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = 0x9E3779B97F4A7C15


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word. bytes.split() splits at exactly the six white space characters of SPACE."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode().split()), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``n`` words; none if there are fewer words."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(size, seed, dtype=np.uint64)
    factor = 1
    for j in range(n):
        factor = (factor * _ODD + 2 * j) % (1 << 64)
        out += words[j : j + size] * np.uint64(factor | 1)
    return mixed(out)
