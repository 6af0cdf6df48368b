"""Benchmark decontamination (operator 3): Wu-Manber search over words.

The alphabet is words (A-Z lower-cased), a pattern is a window of ten words of a
benchmark item, or a whole shorter item.  For patterns of m words, a table over
hashed blocks of three words says how far the search may move when a window ends
with that block: past the whole window if no pattern holds the block.  Where the
shift is zero, the bucket of that suffix block gives the test strings; their
words are compared by hash, and the bytes directly, before an occurrence counts.
All windows of a slice of documents are searched in step: every piece of 64
window starts has a cursor, and each numpy pass moves all cursors.

The tables go to every task.  They take some 70 bytes for each word of the items,
so items beyond PART_BYTES of text are searched in parts, one pass over the
documents for each, and what the passes find is put together.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import row_number, stored
from .common import ALNUM, ASCII_LOWER, flat_ranges, fold, map_arrow, mix, runs, segment_sums, span_hashes, span_keys, text_slices, window_hashes, words_of

WINDOW = 10
BLOCK = 3
PIECE = 64
PART_BYTES = 4 << 20
EXPAND = 1 << 18  # candidates that are compared together


class Items(NamedTuple):
    """The words of all items: their bytes, places and hashes."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray


class Patterns(NamedTuple):
    """Distinct patterns of one length in words, with their search tables."""

    m: int
    block: int
    first: np.ndarray  # the item word that each begins with
    shift: np.ndarray  # by block hash
    bucket: np.ndarray  # patterns in the order of their suffix block
    bucket_slot: np.ndarray  # and the hashes of those blocks
    items: np.ndarray  # item numbers
    items_at: np.ndarray


def _block_slot(words: np.ndarray, ends: np.ndarray, block: int, size: int) -> np.ndarray:
    total = np.zeros(len(ends), np.uint64)
    for k in range(block):
        total = total * np.uint64(0x2545F4914F6CDD1D) + words[ends - k]
    return (mix(total) & np.uint64(size - 1)).astype(np.int64)


def _distinct_windows(first: np.ndarray, item: np.ndarray, m: int, keys: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of distinct windows, and the items of each.  Windows count as
    equal if their words' exact keys are."""
    order = np.lexsort((item, window_hashes(words, m)[first]))
    first, item = first[order], item[order]
    same = np.ones(len(first) - 1, bool)
    for k in range(m):
        for key in keys:
            same &= key[first[1:] + k] == key[first[:-1] + k]
    group = np.concatenate(([0], np.cumsum(~same)))
    again = np.concatenate(([False], same & (item[1:] == item[:-1])))
    return first[np.concatenate(([True], ~same))], item[~again], np.searchsorted(group[~again], np.arange(group[-1] + 2))


def compile_patterns(items: list[tuple[str, str]]) -> tuple[list[str], Items, list[Patterns]]:
    """Item ids in string order, their words, and the tables for each pattern
    length."""
    ids = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(ids)}
    raw = [text.encode() for _, text in items]
    offsets = np.cumsum([0, *map(len, raw)])
    text = ASCII_LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    start, end, bounds = words_of(text, offsets, ALNUM)
    keys = span_keys(text, start, end)
    words = fold(*keys)
    of = np.array([number[name] for name, _ in items], np.int64)
    count = np.diff(bounds)
    out = []
    for m in sorted(set(np.minimum(count, WINDOW).tolist()) - {0}):
        own = np.flatnonzero(np.minimum(count, WINDOW) == m)
        many = count[own] - m + 1
        first, item, item_at = _distinct_windows(flat_ranges(bounds[own], many), np.repeat(of[own], many), m, keys, words)
        block, size = min(BLOCK, m), 1 << 12
        while size < 8 * len(first):
            size *= 2
        shift = np.full(size, m - block + 1, np.uint8)
        for j in range(block, m + 1):
            slot = _block_slot(words, first + j - 1, block, size)
            np.minimum.at(shift, slot, np.uint8(m - j))
        order = np.argsort(slot, kind="stable")
        out.append(Patterns(m, block, first, shift, order, slot[order], item, item_at))
    return ids, Items(text, start, end, words), out


def _equal(low: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray, items: Items, first: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from ``place`` on are those of an item from ``first``
    on, byte by byte."""
    steps = np.arange(m)
    word, own = (place[:, None] + steps).ravel(), (first[:, None] + steps).ravel()
    length = end[word] - start[word]
    right = (length == items.end[own] - items.start[own]).reshape(-1, m).all(1)
    at = np.flatnonzero(np.repeat(right, m))
    if len(at):
        same = low[flat_ranges(start[word[at]], length[at])] == items.text[flat_ranges(items.start[own[at]], length[at])]
        total = length[at].reshape(-1, m).sum(1)
        right[right] = np.logical_and.reduceat(same, np.cumsum(total) - total)
    return right


def search(low: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, bounds: np.ndarray, items: Items, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences: first word, and pattern."""
    windows = np.maximum(np.diff(bounds) - p.m + 1, 0)
    pieces = -(-windows // PIECE)
    cursor = flat_ranges(np.zeros(len(windows), np.int64), pieces) * PIECE + np.repeat(bounds[:-1], pieces)
    stop = np.minimum(cursor + PIECE, np.repeat(bounds[:-1] + windows, pieces))
    at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(cursor):
        slot = _block_slot(words, cursor + p.m - 1, p.block, len(p.shift))
        shift = p.shift[slot].astype(np.int64)
        here = np.flatnonzero(shift == 0)
        low_at, high_at = (np.searchsorted(p.bucket_slot, slot[here], side) for side in ("left", "right"))
        upto = np.cumsum(high_at - low_at)
        begin = 0
        while begin < len(here):  # some candidates at a time, however large the buckets are
            last = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + EXPAND, side="right")))
            many = high_at[begin:last] - low_at[begin:last]
            pattern = p.bucket[flat_ranges(low_at[begin:last], many)]
            place = np.repeat(cursor[here[begin:last]], many)
            for k in range(p.m):
                same = words[place + k] == items.words[p.first[pattern] + k]
                place, pattern = place[same], pattern[same]
            right = _equal(low, start, end, place, items, p.first[pattern], p.m)
            at.append(place[right])
            which.append(pattern[right])
            begin = last
        cursor = cursor + np.maximum(shift, 1)
        left = cursor < stop
        cursor, stop = cursor[left], stop[left]
    return np.concatenate(at), np.concatenate(which)


class Hits(NamedTuple):
    n_words: np.ndarray
    hit: np.ndarray  # of each word
    bounds: np.ndarray  # of each document's words
    documents: np.ndarray  # of each (document, item) pair, in this order
    items: np.ndarray

    @property
    def n_hit(self) -> np.ndarray:
        return segment_sums(self.hit, self.bounds)


def hits_of(data: np.ndarray, offsets: np.ndarray, items: Items, tables: list[Patterns]) -> Hits:
    low = ASCII_LOWER[data]
    start, end, bounds = words_of(low, offsets, ALNUM)
    words = span_hashes(low, start, end)
    change = np.zeros(len(start) + 1, np.int64)
    documents, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in tables:
        place, pattern = search(low, start, end, words, bounds, items, p)
        np.add.at(change, place, 1)
        np.add.at(change, place + p.m, -1)
        many = p.items_at[pattern + 1] - p.items_at[pattern]
        documents.append(np.repeat(np.searchsorted(bounds, place, side="right") - 1, many))
        names.append(p.items[flat_ranges(p.items_at[pattern], many)])
    pairs = np.unique(np.stack([np.concatenate(documents), np.concatenate(names)], 1), axis=0)
    return Hits(np.diff(bounds), np.cumsum(change[:-1]) > 0, bounds, pairs[:, 0], pairs[:, 1])


def pattern_parts(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> list:
    """The search tables as broadcasts, each of items with some ``part_bytes`` of
    text (or one item); one for no items."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna()
    parts = max(1, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    own = lambda k: rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
    return [benchmark.sparkSession.sparkContext.broadcast(compile_patterns([tuple(r) for r in own(k).collect()])) for k in range(parts)]


SPANS = "array<struct<first: long, last: long>>"
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _found(docs: DataFrame, tables, all_rows: bool) -> DataFrame:
    """(row, doc_id, n_words, spans, items) of rows (row, doc_id, text): runs of hit
    words, and the items found; only of rows with hits unless ``all_rows``."""

    def find(batches):
        ids, items, patterns = tables.value
        names = pa.array(ids, pa.string())
        for batch in batches:
            for s in text_slices(batch.column("text")):
                h = hits_of(s.data, s.offsets, items, patterns)
                first, last = runs(h.hit, h.bounds)
                before = h.bounds[np.searchsorted(h.bounds, first, side="right") - 1]
                spans = pa.StructArray.from_arrays([pa.array(first - before), pa.array(last - before)], fields=list(_SPAN))
                rows = np.arange(s.last - s.first)
                lists = [np.searchsorted(first, h.bounds), np.searchsorted(h.documents, np.arange(len(rows) + 1))]
                out = pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(s.first, len(rows)) for c in ("row", "doc_id")), pa.array(h.n_words),
                    pa.ListArray.from_arrays(pa.array(lists[0], pa.int32()), spans), pa.ListArray.from_arrays(pa.array(lists[1], pa.int32()), names.take(pa.array(h.items))),
                ], ["row", "doc_id", "n_words", "spans", "items"])
                yield out if all_rows else out.filter(pa.array(np.diff(lists[0]) > 0))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("row", "doc_id", "text"), find, f"row long, doc_id {id_type}, n_words long, spans {SPANS}, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items,
    items_sha256 and contaminated.

    Null and empty texts have no words and no hits.  Items with a null id or
    text are left out; items with equal ids count once.  Rows with null ids and
    repeated rows are searched like others; empty tables give no rows or no
    hits.  Other columns are not read.
    """
    parts = pattern_parts(benchmark, item_col, item_text_col, part_bytes)
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(parts) == 1:
        found = _found(rows, parts[0], True)
    else:
        rows = stored(rows.drop("row"), "searched").select(row_number().alias("row"), "doc_id", "text")
        passes = [stored(_found(rows, p, k == 0), "found") for k, p in enumerate(parts)]
        found = reduce(DataFrame.unionByName, passes).groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items")
        )
    # spans of several parts may overlap: each counts from the end of those before it
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
    add = lambda t, s: F.struct(F.greatest(t["end"], s["last"]).alias("end"), (t["sum"] + F.greatest(s["last"] - F.greatest(s["first"], t["end"]), F.lit(0))).alias("sum"))
    n_hit = F.aggregate(F.array_sort("spans"), start, add, lambda t: t["sum"])
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark window;
    null and empty texts stay, and so do all rows where there are no items."""
    column = docs.columns.index(text_col)

    def without(rows: DataFrame, tables) -> DataFrame:
        def keep(batches):
            _, items, patterns = tables.value
            for batch in batches:
                hit = [h.n_hit for h in (hits_of(s.data, s.offsets, items, patterns) for s in text_slices(batch.column(column)))]
                yield batch.filter(pa.array(np.concatenate([np.zeros(0, np.int64), *hit]) == 0))

        return map_arrow(rows, keep, rows.schema)

    first, *others = pattern_parts(benchmark, part_bytes=part_bytes)
    out = without(docs, first)
    for tables in others:  # one part's tables in memory at a time
        out = without(stored(out, "searched"), tables)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT m FROM windows
), places AS (
  SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM low, sizes WHERE len(w) >= m)
), found AS (
  SELECT doc_id, m, k, item_id FROM places JOIN windows USING (m, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + m - 1)) AS j FROM (SELECT DISTINCT doc_id, m, k FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
