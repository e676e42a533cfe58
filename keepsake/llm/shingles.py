"""Words, word hashes and rolling hashes of whole texts as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from keepsake.llm.store import memory

#: Distinct words remembered per worker (about 180 bytes each), by all operators together;
#: beyond it the memory is emptied, which changes speed only.
REMEMBERED = 250_000

#: Odd multipliers of the rolling hashes.
_STEP, _RUN = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class WordHashes(dict):
    """64-bit hashes of words (bytes), each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value



_known = WordHashes()
memory("words", _known.clear)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread a sum of products over all 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, lengthened on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                row = np.full(max(n, 1 << 16), base, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_words, _runs = Powers(_STEP), Powers(_RUN)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.to(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:], dtype=np.uint64)
    return out


def span_hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of values[begin:end], equal for equal spans wherever they stand."""
    _, down = powers.to(len(sums))
    return mixed((sums[ends] - sums[begins]) * down[begins])


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values, _words)
    at = np.arange(n)
    return span_hashes(sums, at, at + size, _words)


def run_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(values, _runs), begins, ends, _runs)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    width, low = 1, values
    while 2 * width <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[size - width : size - width + n])
