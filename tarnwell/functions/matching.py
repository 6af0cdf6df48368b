"""Many strings sought in texts at once: Aho-Corasick in arrays.

The automaton is a table of next states by state and kind of byte, and for each state
the highest number of a string that ends there.  Both are built depth by depth for all
strings at once.  Texts are cut to stretches that begin a string's length early, and all
stretches of a batch take their steps together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Entries of the table, four bytes each.
MOST_ENTRIES = 1 << 24

_STRETCH = 256


class TooLarge(ValueError):
    """The table would have more than MOST_ENTRIES entries."""


class Matcher:
    """Of strings numbered by their place in ``strings``: an empty one is found in no text."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(x) for x in strings], np.int64)
        data = np.frombuffer(b"".join(strings), np.uint8)
        used = np.unique(data)
        width = len(used) + 1
        self.kind = np.zeros(256, np.int32)  # 0: in none of the strings
        self.kind[used] = np.arange(1, width)
        self.longest = int(lengths.max(initial=0))
        begin = np.cumsum(lengths) - lengths
        state = np.zeros(len(strings), np.int64)
        levels, n = [], 1
        for depth in range(self.longest):
            on = np.flatnonzero(lengths > depth)
            edges, place = np.unique(state[on] * width + self.kind[data[begin[on] + depth]], return_inverse=True)
            state[on] = n + place
            levels.append((edges // width, edges % width, np.arange(n, n + len(edges))))
            n += len(edges)
            if n * width > MOST_ENTRIES:
                raise TooLarge(f"{n} states of {width} kinds of bytes")
        self.next = np.zeros((n, width), np.int32)
        self.ends = np.full(n, -1, np.int32)
        np.maximum.at(self.ends, state[lengths > 0], np.flatnonzero(lengths > 0))
        shorter = np.zeros(n, np.int64)  # the state of the longest end of a state's string that begins a string
        for depth, (parents, kinds, made) in enumerate(levels):
            if depth:
                shorter[made] = self.next[shorter[parents], kinds]
            self.next[parents, kinds] = made
            self.next[made] = self.next[shorter[made]]
            self.ends[made] = np.maximum(self.ends[made], self.ends[shorter[made]])

    def highest(self, texts: pa.Array) -> np.ndarray:
        """The highest number of a string in each text; -1 for none or no text."""
        texts = texts.cast(pa.large_string())
        out = np.full(len(texts), -1, np.int32)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0) if len(texts) else np.zeros(0, np.int64)
        if not lengths.any() or not self.longest:
            return out
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        stretch = max(_STRETCH, self.longest)
        pieces = -(-lengths // stretch)
        text = np.repeat(np.arange(len(texts)), pieces)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
        early = np.maximum(start - self.longest + 1, 0)
        size = np.minimum(start + stretch, lengths[text]) - early
        order = np.argsort(-size, kind="stable")
        text, size, begin = text[order], size[order], (offsets[text] + early)[order]
        state, best = np.zeros(len(text), np.int32), np.full(len(text), -1, np.int32)
        going = len(text) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")  # at each step
        for step, m in enumerate(going.tolist()):
            state[:m] = self.next[state[:m], self.kind[data[begin[:m] + step]]]
            np.maximum(best[:m], self.ends[state[:m]], out=best[:m])
        np.maximum.at(out, text, best)
        return out
