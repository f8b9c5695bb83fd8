"""Array views of texts: code points of a whole batch, classes by table, and polynomial hashes of any slice in constant time."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_lazy: dict = {}


def categories() -> np.ndarray:
    """The first letter of every code point's Unicode category, as a small number: L 0, M 1, N 2, P 3, S 4, Z 5, C 6."""
    if "categories" not in _lazy:
        order = {k: i for i, k in enumerate("LMNPSZC")}
        out = np.fromiter((order[unicodedata.category(chr(i))[0]] for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        out[[9, 10, 11, 12, 13]] = 5
        _lazy["categories"] = out
    return _lazy["categories"]


def flags(marks: str) -> np.ndarray:
    """A table that is True for the given characters."""
    if marks not in _lazy:
        table = np.zeros(sys.maxunicode + 1, bool)
        table[[ord(x) for x in marks]] = True
        _lazy[marks] = table
    return _lazy[marks]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _lazy or len(_lazy["up"]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, by in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(size, by, np.uint64)
                x[0] = 1
                _lazy[name] = np.cumprod(x, dtype=np.uint64)
    return _lazy["up"], _lazy["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each slice values[begin:end]; equal slices have equal hashes wherever they stand."""
    up, down = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values) * up[: len(values)], dtype=np.uint64)])
        return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def grams(units: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` units."""
    n = max(len(units) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = (h ^ units[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


class Bloom:
    """A Bloom filter of 64-bit hashes with two bits each, of a power of two of bits."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.bits: np.ndarray | None = None  # one byte a bit where that is small

    def __getstate__(self):
        return self.data

    def __setstate__(self, data):
        self.__init__(data)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None and len(self.data) <= 1 << 22:
            self.bits = np.unpackbits(self.data, bitorder="little").view(bool)
        have = (lambda i: self.bits[i]) if self.bits is not None else (lambda i: (self.data[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1)
        u, mask = hashes.view(np.uint64), np.uint64(len(self.data) * 8 - 1)
        out = have((u & mask).astype(np.int64))
        at = np.flatnonzero(out)
        out[at] = have((u[at] >> np.uint64(32) & mask).astype(np.int64))
        return out


def parts_of(texts: list[str], most: int = 1_000_000):
    """Index ranges of ``texts`` that hold about ``most`` characters together: bounds the work arrays whatever a batch holds."""
    begin = 0
    while begin < len(texts):
        size, end = len(texts[begin]), begin + 1
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end
