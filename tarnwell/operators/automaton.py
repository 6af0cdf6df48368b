"""A minimal acyclic automaton of strings with outputs, built by Spark.

The strings are range-sorted; a task reads its range once and keeps only the path of
the present string.  A state is finished when the path leaves it, and it is known by
the digest of what it accepts: its output and its letters with the digests they lead
to.  Equal states therefore get equal digests wherever they come up, and one
aggregation by digest makes the automaton minimal.  Only prefixes of the first and
last string of a task can go on in another: these pieces (tasks times the longest
string) are put together on the driver.

States and edges are counted before they are gathered into arrays; more than
``most_edges`` are refused, so what is broadcast has a checked bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: 12 bytes each in every task, and some 40 on the driver while they are put in order.
MOST_EDGES = 8_000_000
_REMEMBERED = 1 << 18
_CODE_POINT = 21

_STATES = "digest binary, output int, letters array<int>, targets array<binary>, prefix string"


class TooLarge(ValueError):
    """The automaton would have more edges than may be broadcast."""


def _digest(output: int | None, edges: list[tuple[int, bytes]]) -> bytes:
    head = b"" if output is None else str(output).encode()
    return blake2b(head + b"|" + b"".join(c.to_bytes(4, "big") + d for c, d in edges), digest_size=16).digest()


@dataclass
class _Node:
    output: int | None
    edges: list[tuple[int, bytes]]


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of a sorted range; those with a prefix are pieces."""
    path: list[_Node] = [_Node(None, [])]
    first = last = None
    out: list[tuple] = []
    known: set[bytes] = set()

    def leave(depth: int, end: bool) -> None:
        """Finish the states of the present path below ``depth``."""
        while len(path) > depth + 1:
            node, at = path.pop(), len(path)
            node.edges.sort()
            if end or first[:at] == last[:at]:
                out.append((None, node.output, *zip(*node.edges, strict=True), last[:at]) if node.edges else (None, node.output, (), (), last[:at]))
                continue
            name = _digest(node.output, node.edges)
            path[-1].edges.append((ord(last[at - 1]), name))
            if name not in known:
                if len(known) >= _REMEMBERED:
                    known.clear()
                known.add(name)
                out.append((name, node.output, *(zip(*node.edges, strict=True) if node.edges else ((), ())), None))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "output", "letters", "targets", "prefix"])

    for batch in batches:
        for key, output in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if first is None:
                first = key
            else:
                leave(_shared(last, key), False)
            for _ in range(len(key) - len(path) + 1):
                path.append(_Node(None, []))
            last = key
            path[-1].output = output
        if len(out) >= 4096:
            yield batch_of(out)
            out = []
    if last is not None:
        leave(0, True)
        root = path[0]
        root.edges.sort()
        out.append((None, root.output, *(zip(*root.edges, strict=True) if root.edges else ((), ())), ""))
        yield batch_of(out)


@dataclass(frozen=True)
class Automaton:
    """Edges sorted by state and letter; ``outputs`` is -1 where nothing ends."""

    edges: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    root: int

    @property
    def n_bytes(self) -> int:
        return self.edges.nbytes + self.targets.nbytes + self.outputs.nbytes

    def walk(self, strings: pa.Array, longest: bool = False) -> np.ndarray:
        """The output of each string, -1 for one that isn't held; ``longest``: that of
        the longest beginning that has one.  All strings go on by a letter at a time."""
        text = "".join(strings.to_pylist()).encode("utf-32-le")
        letters, size = np.frombuffer(text, "<u4").astype(np.int64), pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        state = np.full(len(size), self.root, np.int64)
        found = np.full(len(size), self.outputs[self.root], np.int32)
        alive, step = np.arange(len(size)), 0
        while True:
            ended = size[alive] == step
            if not longest:
                found[alive[ended]] = self.outputs[state[alive[ended]]]
                lost = alive[~ended]
                found[lost] = -1
            alive = alive[~ended]
            if not len(alive) or not len(self.edges):
                return found
            wanted = state[alive] << _CODE_POINT | letters[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            there = self.edges[at] == wanted
            alive, at = alive[there], at[there]
            state[alive] = self.targets[at]
            if longest:
                output = self.outputs[state[alive]]
                found[alive[output >= 0]] = output[output >= 0]
            step += 1


def build(strings: DataFrame, most_edges: int = MOST_EDGES) -> Automaton:
    """The automaton of (key, output): distinct strings and numbers from 0 on.  A row
    with a null is left out; the empty string is held like others; no rows give an
    automaton that holds nothing."""
    spark = strings.sparkSession
    rows = strings.select(F.col("key").cast("string").alias("key"), F.col("output").cast("int").alias("output")).dropna()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, "key").sortWithinPartitions("key")
    table = stored(ranges.mapInArrow(_states, _STATES), "states")
    whole = table.filter("prefix IS NULL").groupBy("digest").agg(F.first("output").alias("output"), F.first("letters").alias("letters"), F.first("targets").alias("targets"))
    whole = stored(whole, "states-distinct")
    open_ends = table.filter("prefix IS NOT NULL")
    edges = sum(t.agg(F.coalesce(F.sum(F.size("letters") + 1), F.lit(0))).first()[0] for t in (whole, open_ends))
    if edges > most_edges:
        raise TooLarge(f"{edges} states and edges; at most {most_edges} are broadcast")

    pieces: dict[str, _Node] = {}
    for r in open_ends.collect():
        node = pieces.setdefault(r.prefix, _Node(None, []))
        node.output = r.output if node.output is None else node.output
        node.edges += zip(r.letters, map(bytes, r.targets), strict=True)
    made: dict[bytes, _Node] = {}
    pieces = pieces or {"": _Node(None, [])}
    name = b""
    for prefix in sorted(pieces, key=len, reverse=True):
        node = pieces[prefix]
        node.edges.sort()
        name = _digest(node.output, node.edges)
        made[name] = node
        if prefix:
            pieces[prefix[:-1]].edges.append((ord(prefix[-1]), name))
    return _arrays(whole.toArrow(), made, name)


def _arrays(whole: pa.Table, made: dict[bytes, _Node], root: bytes) -> Automaton:
    """Number the states and their edges."""
    kind = pa.list_(pa.binary())
    names = pa.concat_arrays([whole["digest"].cast(pa.binary()).combine_chunks(), pa.array(list(made), pa.binary())])
    outputs = pa.concat_arrays([whole["output"].combine_chunks(), pa.array([m.output for m in made.values()], pa.int32())])
    letters = pa.concat_arrays([whole["letters"].combine_chunks().cast(pa.list_(pa.int32())), pa.array([[c for c, _ in m.edges] for m in made.values()], pa.list_(pa.int32()))])
    targets = pa.concat_arrays([whole["targets"].combine_chunks().cast(kind), pa.array([[d for _, d in m.edges] for m in made.values()], kind)])
    distinct = names.dictionary_encode()  # a piece may be equal to a whole state
    number = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.list_value_length(letters).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.repeat(number, size) << _CODE_POINT | pc.list_flatten(letters).to_numpy(zero_copy_only=False).astype(np.int64)
    to = pc.index_in(pc.list_flatten(targets), value_set=distinct.dictionary).to_numpy(zero_copy_only=False)
    keys, first = np.unique(keys, return_index=True)
    held = np.full(len(distinct.dictionary), -1, np.int32)
    held[number] = outputs.fill_null(-1).to_numpy(zero_copy_only=False)
    return Automaton(keys, to[first].astype(np.int32), held, int(number[len(names) - len(made) + list(made).index(root)]))
