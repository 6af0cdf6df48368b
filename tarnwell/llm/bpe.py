"""Byte-level BPE encoding and decoding (operator 2) by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last of its encoding:
a token that ends the prefix and stands beside the last token of what is before
it without the two ever merging across their boundary.  Storing that token for
each prefix gives the encoding by walking back, lets a text grow at its end with
exact results, and limits the work after an edit to what follows it.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slots, distinct, flat_ranges, map_arrow, text_slices
from .pretoken import PieceCache

NEVER = (1 << 31) - 1
MAX_PAIRS = 400_000
SHORT = 64  # bytes of a piece that is not cut to stretches


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks, their bytes as a trie, and for each token the tokens along the left
    and the right edge of its merges, from the single byte up to itself."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.size = max(ranks.values(), default=0) + 1
        self.length = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.data = np.frombuffer(b"".join(self.tokens.get(k, b"") for k in range(self.size)), np.uint8)
        self.at = np.cumsum(self.length) - self.length
        self._beside: dict[int, bool] = {}
        self._known = Slots(1)
        self._build_trie()
        self._build_merges()

    def _build_trie(self) -> None:
        self.children, self.token_of = Slots(1), [np.full(1, -1, np.int32)]
        which, node, nodes = np.flatnonzero(self.length), np.zeros(np.count_nonzero(self.length), np.int64), 1
        for depth in range(self.longest):
            key = (node << 8) | self.data[self.at[which] + depth]
            names, inverse = np.unique(key, return_inverse=True)
            self.children.insert(np.arange(nodes, nodes + len(names), dtype=np.int32), names.astype(np.uint64))
            node = nodes + inverse
            ends = self.length[which] == depth + 1
            own = np.full(len(names), -1, np.int32)
            own[inverse[ends]] = which[ends]
            self.token_of.append(own)
            nodes += len(names)
            which, node = which[~ends], node[~ends]
        self.token_of = np.concatenate(self.token_of)
        self.roots = self.children.find(np.arange(256, dtype=np.uint64))

    def matches(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on: the last byte, and the token, of all tokens
        that begin at one of the places ``start`` and end before its ``end``."""
        found, place, node = [], start, self.roots[data[start]].astype(np.int64)
        while len(place):
            alive = node >= 0
            place, end, node = place[alive], end[alive], node[alive]
            token = self.token_of[node]
            hit = np.flatnonzero(token >= 0)
            found.append((place[hit], token[hit]))
            more = np.flatnonzero(place + 1 < end)
            place, end = place[more] + 1, end[more]
            node = self.children.find(((node[more] << 8) | data[place]).astype(np.uint64)).astype(np.int64)
        return found

    def _build_merges(self) -> None:
        """All pairs of tokens that make a token, and of each token the pair that
        its last merge joins; shorter tokens come first, as merges need theirs.
        A token that its own bytes don't encode to has no such pair."""
        self.pairs = Slots(1)
        owner = np.repeat(np.arange(self.size), self.length)
        found = self.matches(self.data, np.arange(len(self.data)), (self.at + self.length)[owner])
        heads, tails = np.full(len(self.data), -1, np.int32), np.full(len(self.data), -1, np.int32)
        for k, (last, token) in enumerate(found):
            first = last - k
            head, tail = first == self.at[owner[first]], last + 1 == (self.at + self.length)[owner[last]]
            heads[last[head]] = token[head]  # by its last byte
            tails[first[tail]] = token[tail]  # by its first byte
        cut = np.flatnonzero((heads[:-1] >= 0) & (tails[1:] >= 0) & (owner[:-1] == owner[1:])) if len(heads) else np.zeros(0, np.int64)
        left, right, whole = heads[cut].astype(np.int64), tails[cut + 1].astype(np.int64), owner[cut]
        self.pairs.insert(whole.astype(np.int32), (left << 32 | right).astype(np.uint64))
        depth = 32
        self.left_edge, self.right_edge = (np.full((self.size, depth), NEVER, np.int32) for _ in range(2))
        self.height = np.zeros((2, self.size), np.int64)  # of both edges; 0 for a token without
        single = np.flatnonzero(self.length == 1)
        self.left_edge[single, 0] = self.right_edge[single, 0] = single
        self.height[:, single] = 1
        for length in range(2, self.longest + 1):
            own = np.flatnonzero(self.length[whole] == length)
            own = own[(self.height[0, left[own]] > 0) & (self.height[0, right[own]] > 0) & (left[own] < whole[own]) & (right[own] < whole[own])]
            own = own[self._apart(left[own], right[own], whole[own])]
            if not len(own):
                continue
            a, b, t = left[own], right[own], whole[own]
            self.height[:, t] = self.height[0, a] + 1, self.height[1, b] + 1
            while self.height[:, t].max() >= depth:
                depth *= 2
                self.left_edge, self.right_edge = (np.concatenate((x, np.full_like(x, NEVER)), axis=1) for x in (self.left_edge, self.right_edge))
            self.left_edge[t], self.right_edge[t] = self.left_edge[a], self.right_edge[b]
            self.left_edge[t, self.height[0, t] - 1] = self.right_edge[t, self.height[1, t] - 1] = t

    def _apart(self, left: np.ndarray, right: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether the two tokens of each pair stay apart (by merges of a rank
        ``below``): along the boundary no two tokens that exist at the same time
        merge before one of them goes into its own."""
        out, todo = np.ones(len(left), bool), np.arange(len(left))
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        a, b = left, right
        while len(todo):
            key = self.right_edge[a, i].astype(np.int64) << 32 | self.left_edge[b, j]
            across = self.pairs.find(key.astype(np.uint64))
            across[across < 0] = NEVER
            if below is not None:
                across[across >= below[todo]] = NEVER
            own, other = self.right_edge[a, i + 1], self.left_edge[b, j + 1]
            joined = (across < own) & (across <= other)  # the leftmost of equal ranks goes first
            out[todo[joined]] = False
            go = np.flatnonzero(~joined & ((own < NEVER) | (other < NEVER)))
            up = own[go] <= other[go]
            todo, a, b, i, j = todo[go], a[go], b[go], i[go] + up, j[go] + ~up
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same, with answers kept for up to MAX_PAIRS pairs."""
        key = (left.astype(np.int64) << 32 | right).astype(np.uint64)
        known = self._known.find(key)
        new = np.flatnonzero(known < 0)
        if len(new):
            if self._known.count > MAX_PAIRS:
                self._known = Slots(1)
                new = np.arange(len(key))
            first, which = distinct(key[new])
            answer = self._apart(left[new[first]], right[new[first]]).astype(np.int32)
            self._known.insert(answer, key[new[first]])
            known[new] = answer[which]
        return known > 0

    def spines(self, token: int) -> tuple[list[int], list[int]] | None:
        """The edges of a token; None if its bytes don't encode to it."""
        if not self.height[0, token]:
            return None
        return self.left_edge[token, : self.height[0, token]].tolist(), self.right_edge[token, : self.height[1, token]].tolist()

    def beside(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart."""
        key = left << 32 | right
        if key not in self._beside:
            if len(self._beside) >= MAX_PAIRS:
                self._beside.clear()
            self._beside[key] = bool(self._apart(np.array([left]), np.array([right]))[0])
        return self._beside[key]

    def _last_tokens(self, data: np.ndarray, lengths: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
        """The last token of every prefix of pieces that stand one after the other in
        ``data``, for all pieces in step, by growing prefixes.  ``held`` are those of a
        single piece's first prefixes, where they are known."""
        begin = np.cumsum(lengths) - lengths
        owner_begin, owner_end = np.repeat(begin, lengths), np.repeat(begin + lengths, lengths)
        found = self.matches(data, np.arange(len(data)), owner_end)
        found = [(last[good], token[good]) for last, token in found for good in (self.height[0, token] > 0,)]
        count = np.zeros(len(data) + 1, np.int64)
        for last, _ in found:
            count[last + 1] += 1
        at = np.cumsum(count)
        token_at, fill = np.empty(at[-1], np.int32), at[:-1].copy()
        for last, token in reversed(found):  # the longest first
            token_at[fill[last]] = token
            fill[last] += 1
        prefix = np.full(len(data), -1, np.int32)
        known = 0
        if held is not None:
            known = len(held)
            prefix[:known] = held
        # pieces in order of length, so that those that go on are a tail
        order = np.argsort(lengths, kind="stable")
        sorted_lengths, sorted_begin = lengths[order], begin[order]
        for k in range(known, int(lengths.max(initial=0))):
            last = sorted_begin[np.searchsorted(sorted_lengths, k, side="right") :] + k
            candidate = at[last]
            while len(last):
                if (candidate >= at[last + 1]).any():
                    raise ValueError("no token ends with some byte")
                token = token_at[candidate]
                first = last - self.length[token] + 1
                good = first == owner_begin[last]
                inner = np.flatnonzero(~good)
                good[inner] = self.apart(prefix[first[inner] - 1], token[inner])
                prefix[last[good]] = token[good]
                last, candidate = last[~good], candidate[~good] + 1
        return prefix

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(lengths) - lengths
        prefix = self._last_tokens(np.frombuffer(b"".join(pieces), np.uint8), lengths)
        # back from the end of each piece
        steps, last, rows = [], begin + lengths - 1, np.flatnonzero(lengths)
        last = last[rows]
        many = np.zeros(len(pieces), np.int64)
        while len(rows):
            token = prefix[last]
            steps.append((rows, token))
            many[rows] += 1
            last = last - self.length[token]
            go = last >= begin[rows]
            rows, last = rows[go], last[go]
        ids, end = np.empty(int(many.sum()), np.uint32), np.cumsum(many)
        for back, (rows, token) in enumerate(steps, 1):
            ids[end[rows] - back] = token
        return ids, many

    def encode_long(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of some long pieces, by stretches in step.

        What a prefix's last token is depends on the last tokens of as many prefixes
        before it as the longest token found here has bytes.  So a stretch that is read
        as if the text began some way before it is right as soon as it agrees with the
        stretch before it on that many prefixes.  One that doesn't (in runs of a few
        characters nothing says where tokens begin) is read again from what is known
        before it; stretches that are alike in both are read once."""
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        found = self.matches(data, np.arange(len(data)), np.repeat(np.cumsum(lengths), lengths))
        reach = max(k for k, (last, _) in enumerate(found, 1) if len(last))
        early, stretch = 2 * reach, max(SHORT, 4 * reach)
        cuts = [(piece, place) for piece in pieces for place in range(0, len(piece), stretch)]
        texts = [piece[max(0, place - early) : place + stretch] for piece, place in cuts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        guesses = np.split(self._last_tokens(np.frombuffer(b"".join(texts), np.uint8), sizes), np.cumsum(sizes)[:-1])
        again: dict[tuple[bytes, bytes], np.ndarray] = {}
        out, number = [], 0
        for piece in pieces:
            prefix = np.empty(len(piece), np.int32)
            for place in range(0, len(piece), stretch):
                guess, before = guesses[number], min(place, early)
                number += 1
                held = prefix[max(0, place - reach) : place]
                if not np.array_equal(held, guess[before - len(held) : before]):
                    text = piece[place - reach : place + stretch]
                    key = (text, held.tobytes())
                    if key not in again:
                        again[key] = self._last_tokens(np.frombuffer(text, np.uint8), np.array([len(text)]), held)
                    guess, before = again[key], reach
                prefix[place : place + stretch] = guess[before:]
            ids, last, tokens, size = [], len(piece) - 1, prefix.tolist(), self.length
            while last >= 0:
                ids.append(tokens[last])
                last -= int(size[tokens[last]])
            out.append(ids[::-1])
        return out


class PrefixEncoder:
    """The encoding of one piece of bytes, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", [-1]
        self.append(text)

    def _endings(self, begin: int) -> list[list[int]]:
        """Tokens that end with each byte from ``begin`` on, the longest first."""
        v, before = self.vocabulary, max(0, begin - self.vocabulary.longest)
        data = np.frombuffer(self.text, np.uint8)[before:]
        found: list[list[int]] = [[] for _ in range(len(self.text) - begin)]
        for last, token in reversed(v.matches(data, np.arange(len(data)), np.full(len(data), len(data)))):
            new = np.flatnonzero((last >= begin - before) & (v.height[0, token] > 0))
            for place, own in zip((last[new] + before - begin).tolist(), token[new].tolist(), strict=True):
                found[place].append(own)
        return found

    def append(self, more: bytes) -> None:
        v, begin = self.vocabulary, len(self.text)
        self.text += more
        last, tokens = self.last, v.tokens
        for end, endings in enumerate(self._endings(begin), begin + 1):
            for token in endings:
                start = end - len(tokens[token])
                if not start or v.beside(last[start], token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends with byte {self.text[end - 1]}")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace text[start:end]; prefixes before it keep their tokens, and
        those after it are followed only until they agree with the old ones for
        as long as the longest token."""
        old, tail, moved = self.last, self.text[end:], start + len(new) - end
        self.text, self.last = self.text[:start], old[: start + 1]
        self.append(new)
        agreed = 0
        for k in range(len(tail)):
            self.append(tail[k : k + 1])
            agreed = agreed + 1 if self.last[-1] == old[end + k + 1] and len(self.vocabulary.tokens[self.last[-1]]) <= k + 1 else 0
            if agreed > self.vocabulary.longest:
                self.text += tail[k + 1 :]
                self.last += old[end + k + 2 :]
                break
        assert len(self.last) == len(self.text) + 1 and moved == len(self.text) - len(old) + 1

    def ids(self) -> list[int]:
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[self.last[at]])
        return out[::-1]


class Codec:
    """Encodes and decodes slices of documents; lives as long as a worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = PieceCache(self._encode)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A piece that is a token is that token; others by their prefixes, short
        ones whole, long ones by stretches."""
        get, v = self.vocabulary.ranks.get, self.vocabulary
        whole = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        many = np.ones(len(pieces), np.int64)
        short, long = np.flatnonzero((whole < 0) & (size <= SHORT)), np.flatnonzero((whole < 0) & (size > SHORT))
        ids, many[short] = v.encode([pieces[k] for k in short.tolist()])
        of_long = v.encode_long([pieces[k] for k in long.tolist()])
        many[long] = [len(x) for x in of_long]
        begin = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.uint32)
        out[begin[whole >= 0]] = whole[whole >= 0]
        out[flat_ranges(begin[short], many[short])] = ids
        for k, own in zip(long.tolist(), of_long, strict=True):
            out[begin[k] : begin[k] + len(own)] = own
        return out, many

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and bounds of the documents in them."""
        v = self.vocabulary
        length = v.length[ids]
        total = np.concatenate(([0], np.cumsum(length)))
        return v.data[flat_ranges(v.at[ids], length)], total[bounds]


_codecs: dict[str, Codec] = {}


def codec(name: str, ranks) -> Codec:
    """This worker's codec of a broadcast vocabulary."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(ranks.value)
    return _codecs[name]


def _broadcast(spark: SparkSession, path: str):
    """A vocabulary is a fixed file of some tens of thousands of tokens."""
    ranks = read_ranks(path)
    return hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), spark.sparkContext.broadcast(ranks)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (array; null where
    ``with_ids`` is false), ids_sha256 and decoded_sha256, the last from the bytes
    that the ids decode to.

    Null texts are empty texts: no ids, digests of nothing.  Null ids and
    repeated rows are kept as they come; an empty table gives no rows.
    """
    name, ranks = _broadcast(docs.sparkSession, path)

    def encode(batches):
        own = codec(name, ranks)
        for batch in batches:
            n_tokens, lists, coded, decoded = [], [], [], []
            for s in text_slices(batch.column("text")):
                ids, bounds = own.pieces.ids_of(s)
                raw, at = own.decode(ids, bounds)
                id_bytes, raw_bytes = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
                n_tokens.append(np.diff(bounds))
                coded += [hashlib.sha256(id_bytes[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                decoded += [hashlib.sha256(raw_bytes[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                if with_ids:
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
            n = np.concatenate([np.zeros(0, np.int64), *n_tokens])
            ids_column = pa.concat_arrays(lists) if lists else pa.nulls(len(n), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), ids_column, pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, encode, f"doc_id {id_type}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False).drop("ids")
