"""Word and shingle hashes of many texts at once, with numpy.

A word's hash is a polynomial in its bytes, taken from running sums over the whole buffer, so that no word becomes a
Python object. Shingles combine the hashes of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_CHUNK = 1 << 20  # bytes of text handled at once, unless one text has more
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]  # A-Z count as a-z
    return values


_VALUES = _byte_values()
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a permutation of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts that lie between ``cuts`` in ``data``, and each text's first word (and the end)."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = cuts[1:-1][(cuts[1:-1] > 0) & (cuts[1:-1] < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return hashes, np.searchsorted(start, cuts)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``width`` words as a sorted array of 64-bit hashes.

    A text of fewer words, but not none, has its whole sequence as one; null and empty ones have none.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        yield from _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        i = j


def _sets(data: np.ndarray, cuts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    words, first = _words(data, cuts)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    long = max(0, len(words) - width + 1)
    runs = np.zeros(long, np.uint64)
    for k in range(width):
        runs += words[k : k + long] * factors[k]
    runs = mix(runs)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            short = int(b - a)
            for k in range(int(b - a)):
                short = (short + int(words[a + k]) * int(factors[k])) & _MASK
            yield mix(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)
