"""Hashes of the words of whole texts, straight from Arrow buffers: no Python object for a word, no cache that grows.

A word's hash is a polynomial over a fixed random value for each of its bytes, mixed with its length. Sums of all bytes before each
place give it for every word at once, so a text of any length, and a word of any length, needs a bounded slice of memory at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
TEXTS = 1 << 22
#: Any odd number would do; 3 modulo 8 keeps words with swapped letters apart.
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)
_VALUE = np.random.default_rng(2026).integers(1, 1 << 64, 256, np.uint64)
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolled(x: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of each n consecutive entries."""
    out = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for j in range(n):
        out *= base
        out += x[j : j + len(out)]
    return mixed(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and the last ends; a null text is empty."""
    own = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, 8 * own.offset)
    data = own.buffers()[2]
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data and len(data) else np.zeros(0, np.uint8), offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = TEXTS) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with about ``most`` bytes, one text at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and how many words each text has."""
    space = _SPACE[data]
    first = np.ones(len(data) + 1, bool)
    first[1:] = np.append(space, True)[: len(data)]
    first[offsets] = True  # a text's first byte begins a word, whatever the text before ends with
    last = first[1:] | np.append(space[1:], True)
    starts, ends = np.flatnonzero(first[:-1] & ~space), np.flatnonzero(last & ~space) + 1
    value = _LOWER if lower else _VALUE
    before, after, undo = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    total = np.zeros(1, np.uint64)
    sums = np.empty(SLICE + 1, np.uint64)
    for a in range(0, len(data), SLICE):
        b = min(len(data), a + SLICE)
        own = value[data[a:b]] * _UP[: b - a]
        own *= np.uint64(pow(_BASE, a, 1 << 64))
        sums[0] = total[0]
        np.cumsum(own, out=sums[1 : b - a + 1])
        sums[1 : b - a + 1] += total[0]
        total[0] = sums[b - a]
        i, j = np.searchsorted(starts, [a, b])
        before[i:j] = sums[starts[i:j] - a]
        undo[i:j] = _DOWN[starts[i:j] - a] * np.uint64(pow(_INVERSE, a, 1 << 64))
        i, j = np.searchsorted(ends, [a, b], "right")
        after[i:j] = sums[ends[i:j] - a]
    flat = mixed((after - before) * undo + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.searchsorted(starts, offsets)
    return mixed(flat), np.diff(at)
