"""LM scoring (operator 12): online logistic context mixing.

A text is a sequence of bytes (A-Z lower-cased) and an end, each written as the bits
of a prefix code of the training bytes, so that a letter costs four or five binary
decisions.  For each bit there are four predictors, by the hash of the bit's place in
the code and of a context: the last 3, 4 and 6 bytes and the beginning of the present
word.  A predictor is a table of 2**TABLE_BITS numbers, log odds from the
zeros and ones counted over all training texts.  The log odds are combined with
weights that a gate selects (how deep the bit stands in its code, how many long
contexts are known); the weights learn online, bit for bit, on all training texts, each
of two halves against the counts of the other, so that they don't trust what a text
has itself put into the tables.  While a text is scored its weights are refined after
each BLOCK of its bytes by the same rule, beginning anew with each text, and a last
table corrects the odds by gate and size.  The score is the sum over all bits.

Counts of all training texts are summed by Spark: a task adds up its tables in pages
of 4,096 places and sends those that it has touched; the sums become one signed byte
a place.  Model and broadcast are bounded by the parameters, 8 MB.  In the base model
tokens of at least one in 65,536 are at most 65,536 and go to every task; the rest of
a document's tokens meet their counts in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .common import ASCII_LOWER, NOT_SPACE, Slots, distinct, flat_ranges, map_arrow, segment_sums, span_keys, text_slices, words_of

TABLE_BITS = 20
ORDERS = (3, 4, 6)
PREDICTORS = len(ORDERS) + 1
HALVES = 2
MIXING_ROUNDS = 2
BLOCK = 1024
FREQUENT = 1 << 16

_PAGE = 4096
_CHUNK = 1 << 15
_DEPTHS, _KNOWN = 12, PREDICTORS
_GATES = _DEPTHS * _KNOWN
_SIZES = 33
_END = 256
_RATE, _OWN_RATE = 0.02, 0.02
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_PER_ODDS = 16  # a stored number is 16 times the log odds


@dataclass(frozen=True)
class Code:
    """A prefix code: the bits of symbol s are those at starts[s] and after it."""

    lengths: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    nodes: np.ndarray
    depths: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        """Huffman's code of 256 bytes and the end; each counts once more."""
        heap = [(int(n) + 1, s, s) for s, n in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for inner in range(len(counts), 2 * len(counts) - 1):
            for bit in (0, 1):
                n, _, node = heapq.heappop(heap)
                parent[node] = (inner, bit)
                total = n if bit == 0 else total + n  # noqa: F821
            heapq.heappush(heap, (total, inner, inner))
        paths = []
        for s in range(len(counts)):
            path, node = [], s
            while node in parent:
                path.append(parent[node])
                node = parent[node][0]
            paths.append(path[::-1])
        lengths = np.array([len(p) for p in paths], np.int64)
        flat = [x for p in paths for x in p]
        depths = np.concatenate([np.minimum(np.arange(n), _DEPTHS - 1) for n in lengths])
        nodes = np.array([n for n, _ in flat], np.uint32) * np.uint32(0x9E3779B1)
        return Code(lengths, np.cumsum(lengths) - lengths, np.array([b for _, b in flat], np.uint8), nodes ^ nodes >> np.uint32(15), depths.astype(np.uint8))


@lru_cache(4)
def _powers(n: int, of: int) -> np.ndarray:
    return np.cumprod(np.full(n, of, np.uint64), dtype=np.uint64)


def _power_table(n: int, of: int) -> np.ndarray:
    return _powers(max(1 << 15, 1 << (n - 1).bit_length()), of)[:n]


class Symbols:
    """The symbols of some texts, one end after each, with their contexts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets) + 1
        self.bounds = np.concatenate(([0], np.cumsum(size)))
        self.symbol = np.full(int(self.bounds[-1]), _END, np.uint32)
        self.symbol[np.arange(len(data)) + np.repeat(np.arange(len(size)), size - 1)] = data
        place = np.arange(len(self.symbol), dtype=np.int64) - np.repeat(self.bounds[:-1], size)
        self.contexts = []
        h = np.zeros(len(self.symbol), np.uint32)
        for back in range(1, max(ORDERS) + 1):
            earlier = np.full(len(h), _END, np.uint32)
            earlier[back:] = self.symbol[:-back]
            earlier[place < back] = _END
            h = (h + earlier + np.uint32(1)) * np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(15)
            if back in ORDERS:
                self.contexts.append(h * _ODD[len(self.contexts)])
        self.contexts.append(self._words(place) * _ODD[-1])

    def _words(self, place: np.ndarray) -> np.ndarray:
        """A hash of the bytes of the present word before each symbol, from running
        sums of powers."""
        n = len(self.symbol)
        inside = np.concatenate((NOT_SPACE, [False]))[self.symbol]
        odd, back = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.symbol + np.uint32(1)).astype(np.uint64) * _power_table(n, back) * inside, out=sums[1:])
        start = np.zeros(n, np.int64)  # where the word that the symbol before belongs to begins
        at = np.flatnonzero(~inside) + 1
        start[at[at < n]] = at[at < n]
        start[self.bounds[:-1]] = self.bounds[:-1]
        start = np.maximum.accumulate(start)
        h = (sums[:-1] - sums[start]) * _power_table(n, odd)
        return ((h >> np.uint64(32)) ^ np.minimum(np.arange(n) - start, 31).astype(np.uint64)).astype(np.uint32)

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of symbols of about _CHUNK, cut between blocks of texts."""
        size = np.diff(self.bounds)
        ends = np.repeat(self.bounds[:-1], -(-size // BLOCK)) + BLOCK * (flat_ranges(np.zeros(len(size), np.int64), -(-size // BLOCK)) + 1)
        ends = np.minimum(ends, np.repeat(self.bounds[1:], -(-size // BLOCK)))
        first = 0
        while first < len(self.symbol):
            last = int(ends[max(0, int(np.searchsorted(ends, first + _CHUNK, side="right")) - 1)])
            last = last if last > first else int(ends[np.searchsorted(ends, first, side="right")])
            yield first, last
            first = last

    def bits(self, code: Code, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the symbols of a range: where their bits end, the bits, their depths,
        and their places in the predictors' tables.  Here and below no index is out of
        range: the modes of ``take`` only spare its slower checks."""
        symbol = self.symbol[first:last]
        count = code.lengths[symbol]
        ends = np.cumsum(count)
        of = np.repeat(np.arange(last - first), count)
        flat = (code.starts[symbol] - (ends - count)).take(of)
        flat += np.arange(len(flat))
        node = code.nodes.take(flat, mode="clip")
        places = []
        for context in self.contexts:
            x = context[first:last].take(of, mode="clip")
            x += node
            x ^= x >> np.uint32(13)
            x *= np.uint32(0x5BD1E995)
            x >>= np.uint32(32 - TABLE_BITS)
            places.append(x)
        return ends, code.bits.take(flat, mode="clip"), code.depths.take(flat, mode="clip"), places


@dataclass(frozen=True)
class Mixer:
    """Weights by gate and predictor, and the last table's corrections."""

    weights: np.ndarray
    correction: np.ndarray

    @staticmethod
    def new() -> Mixer:
        return Mixer(np.full((PREDICTORS, _GATES), 0.3, np.float32), np.zeros(_GATES * _SIZES, np.float32))


def _inputs(tables: list[np.ndarray], depths: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of all predictors, and the gate of each bit."""
    odds = np.empty((PREDICTORS, len(depths)), np.float32)
    gate = depths * np.uint8(_KNOWN)
    for n, (table, place) in enumerate(zip(tables, places, strict=True)):
        stored_odds = table.take(place.astype(np.intp), mode="wrap")
        odds[n] = stored_odds
        if n:
            gate += stored_odds != 0
    odds *= np.float32(1 / _PER_ODDS)
    return odds, gate


def _cell(gate: np.ndarray, z: np.ndarray) -> np.ndarray:
    return gate.astype(np.intp) * _SIZES + (np.clip(z, -8, 8) * 2 + 16.5).astype(np.intp)


def _losses(sign: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Nats of each bit."""
    return np.log(1 + np.exp(np.clip(-sign * z, -30, 30)))


def _errors(sign: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Each bit minus its probability."""
    return sign / (1 + np.exp(np.clip(sign * z, -30, 30)))


def _learn(symbols: Symbols, code: Code, tables: list[np.ndarray], weights: np.ndarray, found: np.ndarray) -> int:
    """Move the weights through some texts; add bits, ones and odds of each cell."""
    total = 0
    for first, last in symbols.chunks():
        _, bit, depth, places = symbols.bits(code, first, last)
        odds, gate = _inputs(tables, depth, places)
        sign = bit * np.float32(2) - 1
        for at in range(0, len(bit), 4096):
            part = slice(at, at + 4096)
            g, x = gate[part], odds[:, part]
            single, g = weights.astype(np.float32), g.astype(np.intp)
            z = single[0].take(g, mode="clip") * x[0]
            for n in range(1, PREDICTORS):
                z += single[n].take(g, mode="clip") * x[n]
            error = _errors(sign[part], z)
            cell = _cell(g, z)
            of_bit = np.bincount(cell << 1 | bit[part], minlength=2 * found.shape[1]).reshape(-1, 2)
            rate = _RATE / np.sqrt(of_bit.reshape(_GATES, -1).sum(1) + 1)
            for n in range(PREDICTORS):
                weights[n] += np.bincount(g, error * x[n], _GATES) * rate
            found[0] += of_bit.sum(1)
            found[1] += of_bit[:, 1]
            found[2] += np.bincount(cell, z, found.shape[1])
        total += len(bit)
    return total


def score_texts(symbols: Symbols, code: Code, tables: list[np.ndarray], mixer: Mixer) -> np.ndarray:
    """log10 probability of each text."""
    out = np.zeros(len(symbols.bounds) - 1)
    begin, own = symbols.bounds[:-1], np.zeros(PREDICTORS, np.float32)
    for first, last in symbols.chunks():
        end_of, bit, depth, places = symbols.bits(code, first, last)
        odds, gate = _inputs(tables, depth, places)
        sign = bit * np.float32(2) - 1
        wide = gate.astype(np.intp)
        z = odds[0] * mixer.weights[0].take(wide, mode="clip")
        for n in range(1, PREDICTORS):
            z += odds[n] * mixer.weights[n].take(wide, mode="clip")
        docs = np.arange(np.searchsorted(begin, first, side="right") - 1, np.searchsorted(begin, last))
        bit_at = lambda symbol: int(end_of[symbol - first - 1]) if symbol > first else 0
        long = docs[(symbols.bounds[docs + 1] - begin[docs]) > BLOCK]
        for doc in long.tolist():
            start, stop = int(symbols.bounds[doc]), int(symbols.bounds[doc + 1])
            at = max(start, first)
            if at == start:
                own = np.zeros(PREDICTORS, np.float32)
            while at < min(stop, last):
                after = min(at + BLOCK, stop)
                part = slice(bit_at(at), bit_at(after))
                z[part] += own @ odds[:, part]
                error = _errors(sign[part], z[part])
                own = own + np.float32(_OWN_RATE) * (odds[:, part] @ error) / np.float32(np.sqrt(part.stop - part.start))
                at = after
        z += mixer.correction.take(_cell(wide, z), mode="clip")
        loss = _losses(sign, z)
        of_doc = np.array([bit_at(max(int(begin[d]), first)) for d in docs.tolist()])
        out[docs] -= np.add.reduceat(loss.astype(np.float64), of_doc)
    return out / np.log(10)


def _symbols(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, object, np.ndarray, Symbols]]:
    for batch in batches:
        for part in text_slices(batch.column(column), _CHUNK):
            low = ASCII_LOWER[part.data]
            yield batch, part, low, Symbols(low, part.offsets)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Symbols]]:
    """The symbols of rows (text, half), by half."""
    for batch in batches:
        of = batch.column(1).to_numpy(zero_copy_only=False)
        for half in range(HALVES):
            for part in text_slices(batch.column(0).filter(pa.array(of == half)), _CHUNK):
                yield half, Symbols(ASCII_LOWER[part.data], part.offsets)


def _rows(columns: dict[str, object], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    """A batch in which columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in schema.items()], names=list(schema))


_TOKENS = {"low": pa.int64(), "high": pa.int64(), "n": pa.int64()}


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens by key, and under keys of the last byte 0xFE the bytes."""
    for batch in batches:
        for part in text_slices(batch.column(0)):
            low = ASCII_LOWER[part.data]
            words = words_of(low, part.offsets, NOT_SPACE)
            a, b = span_keys(low, words.start, words.end)
            first, which = distinct(a, b)
            of_byte = np.bincount(low, minlength=256)
            seen = np.flatnonzero(of_byte)
            keys = np.concatenate((a[first], [np.uint64(0)], seen.astype(np.uint64))).view(np.int64)
            marks = np.concatenate((b[first], [np.uint64(0)], np.full(len(seen), 0xFE << 56, np.uint64))).view(np.int64)
            yield _rows({"low": keys, "high": marks, "n": np.concatenate((np.bincount(which, minlength=len(first)), [len(part.valid)], of_byte[seen]))}, _TOKENS)


_BYTE_MARK = int(np.array(0xFE << 56, np.uint64).view(np.int64))


def _count_bits(code: Code):
    """Pages of zeros and ones, apart for each half of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((HALVES, PREDICTORS, 2 << TABLE_BITS), np.int32)
        for half, symbols in _halves(batches):
            for first, last in symbols.chunks():
                _, bit, _, places = symbols.bits(code, first, last)
                for n, place in enumerate(places):
                    np.add.at(counts[half, n], (place << np.uint32(1) | bit).astype(np.intp), np.int32(1))
        for half in range(HALVES):
            pages = counts[half].reshape(-1, 2 * _PAGE)
            touched = np.flatnonzero(pages.any(1))
            for at in range(0, len(touched), 64):
                some = touched[at : at + 64]
                packed = [pa.compress(pages[p].tobytes(), codec="zstd", asbytes=True) for p in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([half] * len(some), pa.int32()), pa.array(packed, pa.binary())], names=["page", "half", "counts"])

    return run


def _add_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the pages of a task, in bounded memory: there are only so many pages."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, half, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = np.frombuffer(pa.decompress(packed, 8 * _PAGE, codec="zstd", asbytes=True), np.int32)
            sums.setdefault(page, np.zeros((HALVES, 2 * _PAGE), np.int64))[half] += counts

    def odds(counts: np.ndarray) -> bytes:
        zeros, ones = counts.reshape(-1, 2).T + 0.1
        return np.clip(np.rint(_PER_ODDS * np.log(ones / zeros)), -127, 127).astype(np.int8).tobytes()

    for page, (first, second) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([odds(second)]), pa.array([odds(first)]), pa.array([odds(first + second)])], names=["page", "but_first", "but_second", "every"])


def _mixing_pass(code: Code, others: list[list[np.ndarray]], mixer: Mixer):
    """Learn on each text of each half against ``others`` of that half: the counts of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, found, total = mixer.weights.astype(np.float64), np.zeros((3, _GATES * _SIZES)), 0
        for half, symbols in _halves(batches):
            total += _learn(symbols, code, others[half], weights, found)
        if total:
            values = np.concatenate(((weights * total).ravel(), [total], found.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([values.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


@dataclass(frozen=True)
class Model:
    """What scoring needs in every task; counts is a table of all other tokens."""

    code: Code
    tables: list[np.ndarray]
    mixer: Mixer
    counts: DataFrame
    frequent: np.ndarray
    tokens: int
    kinds: int

    @property
    def smallest(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from all rows that aren't held out."""
    spark = docs.sparkSession
    number = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0))
    half = F.pmod(F.floor(number / 5), F.lit(HALVES)).cast("int")
    training = docs.filter(~is_held_out(id_col)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), half.alias("half"))

    counted = stored(map_arrow(training.select("text"), _count_tokens, "low long, high long, n long").groupBy("low", "high").agg(F.sum("n").alias("n")), "tokens")
    of_byte = np.zeros(_END + 1, np.int64)
    for r in counted.filter(F.col("high") == _BYTE_MARK).collect():
        of_byte[r.low] = r.n
    counts = counted.filter(F.col("high") != _BYTE_MARK)
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    is_end = (F.col("low") == 0) & (F.col("high") == 0)
    often = counts.filter((F.col("n") * FREQUENT >= tokens) | is_end).collect()
    of_byte[_END] = next((r.n for r in often if not r.low and not r.high), 0)
    code = Code.of(of_byte)

    pages = map_arrow(training, _count_bits(code), "page long, half int, counts binary").repartition("page")
    tables = np.zeros((HALVES + 1, PREDICTORS << TABLE_BITS), np.int8)
    for r in map_arrow(pages, _add_pages, "page long, but_first binary, but_second binary, every binary").collect():
        for n, raw in enumerate((r.but_first, r.but_second, r.every)):
            tables[n, r.page * _PAGE : (r.page + 1) * _PAGE] = np.frombuffer(raw, np.int8)
    *others, every = (list(t.reshape(PREDICTORS, -1)) for t in tables)

    mixer = Mixer.new()
    held = spark.sparkContext.broadcast(others)
    for _ in range(MIXING_ROUNDS):
        run = _mixing_pass_of(code, held, mixer)
        sums = map_arrow(training, run, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        if not sums:
            break
        values = np.zeros(len(sums))
        for r in sums:
            values[r.pos] = r.n
        cut = PREDICTORS * _GATES
        weights = (values[:cut] / values[cut]).reshape(PREDICTORS, _GATES).astype(np.float32)
        n, ones, z = values[cut + 1 :].reshape(3, -1)
        correction = (np.log((ones + 0.5) / (n - ones + 0.5)) - z / np.maximum(n, 1)) * n / (n + 200)
        mixer = Mixer(weights, np.clip(correction, -2, 2).astype(np.float32))
    held.unpersist()
    frequent = np.array([(r.low, r.high, r.n) for r in often], np.int64).reshape(-1, 3)
    return Model(code, every, mixer, counts, frequent, tokens, kinds)


def _mixing_pass_of(code: Code, others, mixer: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _mixing_pass(code, others.value, mixer)(batches)

    return run


_SCORED = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), **_TOKENS}


def _scoring(code: Code, mixer: Mixer, smallest: float, broadcast):
    """A row for each text, and one for each of its tokens that is not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, frequent = broadcast.value
        keys = [np.ascontiguousarray(frequent[:, n]).view(np.uint64) for n in (0, 1)]
        slots = Slots(2)
        slots.insert(np.arange(len(frequent), dtype=np.int32), *keys)
        worth = np.log10((frequent[:, 2] + 0.5) / smallest)
        end = slots.find(np.zeros(1, np.uint64), np.zeros(1, np.uint64))[0]
        end_worth = worth[end] if end >= 0 else np.log10(0.5 / smallest)
        row = TaskContext.get().partitionId() << 40
        for batch, part, low, symbols in _symbols(batches, 2):
            n = len(part.valid)
            words = words_of(low, part.offsets, NOT_SPACE)
            a, b = span_keys(low, words.start, words.end)
            number = slots.find(a, b)
            known = number >= 0
            size = np.diff(words.bounds)
            doc = np.repeat(np.arange(n), size)
            base = np.bincount(doc[known], worth[number[known]], n) + end_worth
            rows = slice(part.first, part.last)
            yield _rows({"row": row + np.arange(n), "doc_id": batch.column(0)[rows], "held_out": batch.column(1)[rows], "n_tokens": size + 1, "n_known": segment_sums(known, words.bounds) + int(end >= 0), "base_score": base, "score": score_texts(symbols, code, tables, mixer)}, _SCORED)
            rest = np.flatnonzero(~known)
            first, which = distinct(a[rest], b[rest], doc[rest].astype(np.uint64))
            if len(first):
                yield _rows({"row": row + doc[rest][first], "low": a[rest][first].view(np.int64), "high": b[rest][first].view(np.int64), "n": np.bincount(which)}, _SCORED)
            row += n

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10 probabilities).

    Null texts count as empty: one token, the end.  Repeated rows are scored alike and
    a null id is not held out.  Without training rows the base score is that of no
    counts and no kinds (0) and the model's that of even odds for each bit.  An empty
    table gives an empty result.  Other columns are not read.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast((model.tables, model.frequent))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, low long, high long, n long"
    table = stored(map_arrow(rows, _scoring(model.code, model.mixer, model.smallest, broadcast), schema), "scores")
    rare = table.filter("low IS NOT NULL").select("row", "low", "high", "n")
    counts = model.counts.filter(F.col("n") * FREQUENT < model.tokens).withColumnRenamed("n", "c")
    met = rare.join(counts, ["low", "high"], "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more"),
        F.sum(F.col("n") * F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.5) / F.lit(float(model.smallest)))).alias("worth"),
    )
    return table.filter("low IS NULL").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("worth", F.lit(0.0))).alias("base_score"), "score",
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, learning from those whose crc32 modulo 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs))
