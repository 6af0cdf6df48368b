"""Byte-level helpers that the Arrow-batched operators share.

Spark hands ``mapInArrow`` a string column as one contiguous UTF-8 buffer with
offsets, so words are cut, lower-cased and hashed for thousands of documents in
a few numpy passes, without a Python object per word.  Slices of a batch are
bounded in bytes; one text longer than the bound makes a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SLICE_ROWS = 4096
BATCH_BYTES = 4 << 20

#: Word bytes of `[^\x20\x09-\x0D]+`; every byte above 0x7F belongs to a word.
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACES

#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_low : _high + 1] = False

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32


class Slice(NamedTuple):
    """Rows ``first`` to ``last`` (exclusive) of a batch; document k holds
    ``data[offsets[k]:offsets[k + 1]]`` and is null where ``valid`` is false."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of at most ``limit`` bytes (or one row) and
    at most SLICE_ROWS rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + SLICE_ROWS, n)
        low, high = int(offsets[first]), int(offsets[last])
        yield Slice(first, last, data[low:high], offsets[first : last + 1] - low, valid[first:last])
        first = last


class Words(NamedTuple):
    """Words of a slice: byte ranges, and ``bounds`` so that document k has
    words ``bounds[k]`` to ``bounds[k + 1]``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a document."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[edges - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def words_of(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> Words:
    start, end = runs(word_byte[data], offsets)
    return Words(start, end, np.searchsorted(start, offsets, side="left"))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as an integer, zeros after the end;
    valid up to position len(data) + 8."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    return np.ndarray((len(data) + 9,), "<u8", padded.data, strides=(1,))


SHORT = 15
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words that are equal for equal ranges of bytes only: of a range
    of up to 15 bytes the bytes themselves and their number, of a longer one 120
    bits of its BLAKE2b digest and a mark."""
    size = end - start
    at = byte_words(data)
    low = at[start] & _KEEP[np.minimum(size, 8)]
    high = at[start + 8] & _KEEP[np.clip(size - 8, 0, 7)]
    high |= np.minimum(size, SHORT).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[long] = pairs[:, 0]
        high[long] = pairs[:, 1] | np.uint64(0xFF << 56)
    return low, high


def fold(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each pair."""
    return mix(low ^ mix(high ^ np.uint64(0x9E3779B97F4A7C15)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, by its exact key."""
    return fold(*span_keys(data, start, end))


def chained(total: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of its beginning and its next member; a
    step is not linear, so no arithmetic relation of members survives it."""
    return mix((total << np.uint64(1) | total >> np.uint64(63)) + mix(value ^ np.uint64(0xC2B2AE3D27D4EB4F)))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of all ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = chained(total, values[k : k + n])
    return total


class Slots:
    """A hash table of arrays: rows of 64-bit keys, each with a number, found and
    put in for whole arrays at once.  Keys are compared, not only hashed."""

    def __init__(self, columns: int, size: int = 1 << 12):
        self.keys = [np.zeros(size, np.uint64) for _ in range(columns)]
        self.number = np.full(size, -1, np.int32)
        self.count = 0

    def _first(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        hashed = mix(keys[0]) if len(keys) == 1 else fold(*keys)
        return (hashed & np.uint64(len(self.number) - 1)).astype(np.int64)

    def find(self, *keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one that isn't there."""
        last, place = len(self.number) - 1, self._first(keys)
        found = self.number[place]
        differ = self.keys[0][place] != keys[0]
        for own, key in zip(self.keys[1:], keys[1:], strict=True):
            differ |= own[place] != key
        other = np.flatnonzero(differ & (found >= 0))
        while len(other):  # on to the next places, until the key or an empty one
            at = place[other] = (place[other] + 1) & last
            found[other] = self.number[at]
            differ = found[other] >= 0
            unequal = np.zeros(len(other), bool)
            for own, key in zip(self.keys, keys, strict=True):
                unequal |= own[at] != key[other]
            other = other[differ & unequal]
        return found

    def insert(self, number: np.ndarray, *keys: np.ndarray) -> None:
        """Put in distinct keys that aren't there yet."""
        self.count += len(number)
        if 2 * self.count > len(self.number):
            old = np.flatnonzero(self.number >= 0)
            held, old_keys = self.number[old], [k[old] for k in self.keys]
            size = len(self.number)
            while 2 * self.count > size:
                size *= 2
            self.keys, self.number = [np.zeros(size, np.uint64) for _ in keys], np.full(size, -1, np.int32)
            self._put(held, tuple(old_keys))
        self._put(number, keys)

    def _put(self, number: np.ndarray, keys: tuple[np.ndarray, ...]) -> None:
        last, place, left = len(self.number) - 1, self._first(keys), np.arange(len(number))
        while len(left):
            free = left[self.number[place[left]] < 0]
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            for own, key in zip(self.keys, keys, strict=True):
                own[place[put]] = key[put]
            self.number[place[put]] = number[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            place[left] = (place[left] + 1) & last


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key first comes in a sort, and which of them each is."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def flat_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one after the other."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(start, np.int64) - (np.cumsum(length) - length)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, length)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[k]:bounds[k + 1]] as int64; empty segments give 0."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _release() -> None:
    """Give memory that is free back to the system; a worker lives for many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library


def map_arrow(df, function, schema: str):
    """``mapInArrow`` with batches of at most BATCH_BYTES (or one row): a batch
    stands in memory twice on both sides.  The bound is a setting of the session
    and stays set."""

    def bounded(batches):
        yield from function(batches)
        _release()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(bounded, schema)


def hash_below(order, wanted: int, total):
    """A condition on a 64-bit hash column that lets through about four times
    ``wanted`` of ``total`` rows (all, if there are fewer): what then goes on to
    pick the ``wanted`` smallest is bounded whatever the table's size."""
    from pyspark.sql import functions as F

    share = F.least(F.lit(1.0), F.lit(4.0 * wanted) / F.greatest(total, F.lit(1)))
    return order.cast("double") <= F.lit(2.0**64) * share - F.lit(2.0**63)
