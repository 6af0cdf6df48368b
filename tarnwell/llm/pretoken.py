"""Cuts texts as the public byte-level BPE pattern does, for a slice of documents
at a time, and keeps the ids of pieces seen before.

The pattern (`'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`)
only looks at character classes and at most two characters ahead, so the starts
of its matches are boolean expressions over the classes of neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import regex

from .common import Slice, Slots, distinct, flat_ranges, span_keys

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: The white space of the pattern's `\s`.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[_WHITE] = SPACE
    return table


class Pieces(NamedTuple):
    """Byte ranges of the matches; document k has pieces bounds[k] to bounds[k + 1]."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def cut(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """The matches of the pattern in each document."""
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    n = len(at)
    if not n:
        none = np.zeros(0, np.int64)
        return Pieces(none, none, np.zeros(len(offsets), np.int64))
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    edges = np.searchsorted(at, offsets)
    opens = np.zeros(n + 1, bool)  # the first character of a document
    opens[edges] = True
    opens[n] = True
    kind = _classes()[chars]
    space, blank = kind == SPACE, chars == 0x20
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~opens[:n]
    before[opens[:n]] = 255
    # a run of one class begins, and no blank before it belongs to it
    start = (kind != before) & (space | ~after_blank)
    # the last white space before another character stands alone or joins it
    last_space = space.copy()
    last_space[:-1] &= ~space[1:]
    last_space &= ~opens[1:]
    start |= last_space
    # contractions, where a match can begin at the apostrophe
    tick = np.flatnonzero((chars == 0x27) & (before != OTHER) & ~after_blank)
    if len(tick):
        padded = np.concatenate((chars, [0, 0]))
        closes = np.concatenate((opens[1:], [True, True]))
        one, two = padded[tick + 1], padded[tick + 2]
        one = np.where(closes[tick], 0, one)
        two = np.where(closes[tick] | closes[tick + 1], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, width in ((short, 2), (long, 3)):
            first = tick[which]
            start[first + 1] = False
            rest = first + width
            rest = rest[rest < n]
            # letters that go on after a contraction begin a match of their own
            start[rest[kind[rest] == LETTER]] = True
    first = np.flatnonzero(start)
    ends = np.append(first[1:], n)
    at = np.append(at, len(data))
    return Pieces(at[first], at[ends], np.searchsorted(first, edges))


class PieceCache:
    """Ids of the pieces met so far, looked up for whole slices at once.

    A piece is known by its exact key (`span_keys`), never by a hash of it alone.
    The cache is emptied when it holds ``most`` pieces or ``most_ids`` ids; with
    the defaults that keeps it below 50 MB.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, most_ids: int = 2_000_000):
        """``encode`` gives the ids of pieces, one after the other, and how many
        each has."""
        self.encode, self.most, self.most_ids = encode, most, most_ids
        self._clear()

    def _clear(self) -> None:
        self.slots = Slots(2, 1 << 16)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)

    def _append(self, ids: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with their ids."""
        have, total = self.slots.count, self.slots.count + len(lengths)
        number = np.arange(have, total, dtype=np.int32)
        self.slots.insert(number, low, high)
        begin = self.at[have]
        if len(self.at) <= total:
            self.at = np.concatenate((self.at, np.zeros(total, np.int64)))
        if len(self.ids) < begin + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros(begin + len(ids), np.uint32)))
        self.ids[begin : begin + len(ids)] = ids
        self.at[have + 1 : total + 1] = begin + np.cumsum(lengths)
        return number

    def ids_of(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and bounds so that document k has ids bounds[k] to
        bounds[k + 1]."""
        pieces = cut(s.data, s.offsets)
        if self.slots.count > self.most or self.at[self.slots.count] > self.most_ids:
            self._clear()
        low, high = span_keys(s.data, pieces.start, pieces.end)
        number = self.slots.find(low, high)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            first, which = distinct(low[missing], high[missing])
            first = missing[first]
            raw = s.data.tobytes()
            new = [raw[a:b] for a, b in zip(pieces.start[first].tolist(), pieces.end[first].tolist(), strict=True)]
            number[missing] = self._append(*self.encode(new), low[first], high[first])[which]
        begin = self.at[number]
        many = self.at[number + 1] - begin
        total = np.concatenate(([0], np.cumsum(many)))
        return self.ids[flat_ranges(begin, many)], total[pieces.bounds]
