"""Kernels over whole batches of texts: words and their hashes in numpy, and a compact hash table.

White space is that of the contracts, and A-Z are lower-cased; hashes are 64-bit sums of random byte
codes times powers of an odd number, scattered by a bijection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of texts that are worked on at once, in some forty times as much memory; a longer text is worked on alone.
CHUNK_BYTES = 1 << 18
CHUNK_ROWS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ROLL = 0x9E3779B97F4A7C55
_UNROLL = pow(_ROLL, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = mix(np.arange(1, 257, dtype=U64))[_LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    found = np.empty(n, U64)
    found[0], at = 1, 1
    while at < n:
        more = min(at, n - at)
        found[at : at + more] = found[:more] * U64(pow(base, at, 1 << 64))
        at += more
    return found


_up, _down = _powers(_ROLL, 1 << 12), _powers(_UNROLL, 1 << 12)


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for n bytes; those for a chunk are kept, those for a longer text are not."""
    global _up, _down
    if n <= len(_up):
        return _up, _down
    size = max(n, 2 * len(_up))
    up, down = _powers(_ROLL, size), _powers(_UNROLL, size)
    if size <= 2 * CHUNK_BYTES:
        _up, _down = up, down
    return up, down


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], A-Z lower-cased."""
    up, down = _both_powers(max(1, len(data)))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[np.minimum(starts, max(0, len(data) - 1))])


def sequence_hashes(hashes: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence hashes[first:last + 1]."""
    up, down = _both_powers(max(1, len(hashes)))
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[lasts + 1] - sums[firsts]) * down[firsts])


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text) of texts data[offsets[i]:offsets[i + 1]], which lie one after another from 0."""
    inside = ~_IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edges] = inside[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


@dataclass
class Words:
    """The words of some texts, in order: hash and place in the texts' bytes, and for each text the first of its words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, bounds = word_places(data, offsets)
    return Words(range_hashes(data, starts, ends), starts, ends, bounds)


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of a binary column in chunks of bounded size; null is empty."""
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, where, stored = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(stored, np.uint8) if stored is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, at + CHUNK_ROWS, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class HashTable:
    """64-bit keys with values in open addressing: 24 bytes an entry, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, at = np.unique(keys, return_index=True)
        values = values[at]
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.full = np.zeros(size, U64), np.zeros(size, values.dtype), np.zeros(size, bool)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.full[slots[left]]]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.values[slots[placed]], self.full[slots[placed]] = keys[placed], values[placed], True
            left = np.setdiff1d(left, placed, assume_unique=True)
            slots[left] = (slots[left] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether there) of each key."""
        slots = self._slots(keys)
        met = self.full[slots] & (self.keys[slots] == keys)
        left = np.flatnonzero(self.full[slots] & ~met)
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            here, full = slots[left], self.full[slots[left]]
            same = full & (self.keys[here] == keys[left])
            met[left[same]] = True
            left = left[full & ~same]
        return np.where(met, self.values[slots], 0), met
