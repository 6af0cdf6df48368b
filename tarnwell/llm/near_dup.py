"""MinHash near-dedup (operator 7) with HyperMinHash sketches.

A document's set of distinct five-word shingles is sketched in 256 registers: a
hash picks the bucket, and of the bucket's smallest hash the register keeps the
number of leading zeros and ten mantissa bits.  Buckets that stay empty are
filled by further rounds of hashing, so every register of two documents agrees
with the probability of their Jaccard similarity, small sets included.  Registers
are cut into 64 bands of four; at similarity 0.75 two documents miss each other
in all bands with probability 3e-11.

Documents with equal sets are one class and go on as one representative, under a
number of its own; a document id that several classes hold links them.  Where a
bucket of a band holds several representatives,

1.  each is paired with the bucket's smallest (a star, not all pairs);
2.  a pair whose collision-corrected estimate is within six standard errors of
    the threshold is confirmed on the full sets;
3.  links are joined into components by alternating large and small stars.

A bucket whose members then lie in one component needs nothing more: whatever
further links it holds change no component.  In the others, members of different
components are compared by their registers, each pair in the first band where
the two meet, and at once confirmed on their full sets: what leaves the task are
links that join components, not pairs.  Large buckets are compared block against
block, and each block against itself; a block is bounded in members and in
shingles.

Shingles are 64-bit hashes chained over the exact keys of their words; a set is
known by 128 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, row_number, shared_folder, stored
from .common import ASCII_LOWER, NOT_SPACE, chained, flat_ranges, map_arrow, mix, segment_sums, span_hashes, text_slices, window_hashes, words_of

SHINGLE = 5
REGISTERS = 256
MANTISSA = 10
BITS = 48  # of a hash that a register is made of
BAND = 4
SIMILARITY = 75  # percent
MARGIN = 6  # standard errors
BLOCK = 4096  # members of a bucket in one block
BLOCK_SHINGLES = 1 << 20  # and their shingles, on average
CONFIRM_ROWS = 512  # pairs whose sets are in memory together
_SEEDS = np.random.default_rng(977).integers(1, 1 << 63, 4096, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles: document and hash, sorted by both."""
    low = ASCII_LOWER[data]
    start, end, bounds = words_of(low, offsets, NOT_SPACE)
    words = span_hashes(low, start, end)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(len(count)), count)
    windows = window_hashes(words, SHINGLE)
    whole = owner[: len(windows)] == owner[SHINGLE - 1 :] if len(windows) else np.zeros(0, bool)
    owner, value = owner[: len(windows)][whole], windows[whole]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        total = count[short].astype(np.uint64)
        for k in range(SHINGLE - 1):
            more = count[short] > k
            total[more] = chained(total[more], words[bounds[short[more]] + k])
        owner = np.concatenate((owner, short))
        value = np.concatenate((value, total))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def registers(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """HyperMinHash registers of ``n`` sets, n x 256 of 16 bits; 0xFFFF if empty."""
    never = np.uint64((1 << 64) - 1)
    least = np.full(n * REGISTERS, never, np.uint64)
    done, seeds = 0, len(_SEEDS)
    while len(owner) and done < seeds:
        rounds = 1 if not done else int(min(seeds - done, 512, max(1, 200_000 // len(owner))))
        hashes = mix(value[:, None] + _SEEDS[done : done + rounds])
        slot = owner[:, None] * REGISTERS + (hashes & np.uint64(REGISTERS - 1)).astype(np.int64)
        # an earlier round counts before a smaller hash
        key = (np.arange(done, done + rounds, dtype=np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS))
        np.minimum.at(least, slot.ravel(), key.ravel())
        done += rounds
        open_ = (least.reshape(n, REGISTERS) == never).any(1)[owner]
        owner, value = owner[open_], value[open_]
    rest = least & np.uint64((1 << BITS) - 1)
    exponent = np.frexp(rest.astype(np.float64))
    zeros = (BITS - exponent[1]).astype(np.uint64)
    mantissa = ((exponent[0] * 2 - 1) * (1 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1).astype(np.uint64)
    out = np.where(least == never, np.uint64(0xFFFF), (zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return out.reshape(n, REGISTERS)


@lru_cache(maxsize=1)
def _collisions() -> np.ndarray:
    """Probability that a register of two disjoint sets is equal, by the binary
    logarithm of the hashes in a bucket."""
    low = np.concatenate([2.0 ** -(i + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for i in range(BITS)])
    width = np.repeat([2.0 ** -(i + 1) / (1 << MANTISSA) for i in range(BITS)], 1 << MANTISSA)
    return np.array([np.sum((np.exp(np.log1p(-low) * 2.0**k) - np.exp(np.log1p(-np.minimum(low + width, 1 - 1e-16)) * 2.0**k)) ** 2) for k in range(33)])


def estimates(equal: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Jaccard similarities from the share of equal registers, corrected for
    registers that are equal by chance."""
    fill = np.maximum(1, (a_size + b_size) / 2 / REGISTERS)
    chance = _collisions()[np.minimum(np.log2(fill).astype(int), 32)]
    return (equal - chance) / (1 - chance)


def least_estimate(similarity: int) -> float:
    s = similarity / 100
    return s - MARGIN * (s * (1 - s) / REGISTERS) ** 0.5


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles, two digests of the set, registers."""

    def sketch(batches):
        for batch in batches:
            out = []
            for s in text_slices(batch.column("text")):
                n = s.last - s.first
                owner, value = shingles(s.data, s.offsets)
                bounds = np.searchsorted(owner, np.arange(n + 1))
                sums = []
                for seed in (0x165667B19E3779F9, 0x27D4EB2F165667C5):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(seed)))))
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                out.append((np.diff(bounds), *sums, registers(owner, value, n)))
            if out:
                size, one, two, sketch = (np.concatenate(x) for x in zip(*out, strict=True))
                raw = pa.py_buffer(np.ascontiguousarray(sketch))
                wide = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), len(size), [None, raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(size), pa.array(one), pa.array(two), wide], ["doc_id", "text_hash", "n_shingles", "one", "two", "sketch"])

    return map_arrow(docs.select("doc_id", "text_hash", "text"), sketch, "doc_id long, text_hash long, n_shingles long, one long, two long, sketch binary")


def _sketch_rows(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(2 * REGISTERS))
    return np.frombuffer(fixed.buffers()[1], np.uint16, len(fixed) * REGISTERS, fixed.offset * 2 * REGISTERS).reshape(-1, REGISTERS)


def _bands(classes: DataFrame) -> DataFrame:
    """(band, node): a hash of four registers, its last six bits the band's place."""
    width, bands = 2 * BAND, REGISTERS // BAND
    key = lambda k: F.xxhash64(F.substring("sketch", F.lit(width) * k + 1, F.lit(width)), k).bitwiseAND(F.lit(-bands)).bitwiseOR(k.cast("long"))
    return classes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)).alias("band"), "node")


def _estimated(pairs: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that sizes and registers let through."""
    least = least_estimate(similarity)

    def passing(batches):
        for batch in batches:
            equal = (_sketch_rows(batch.column("a_sketch")) == _sketch_rows(batch.column("b_sketch"))).mean(1)
            a, b = (batch.column(c).to_numpy() for c in ("a_size", "b_size"))
            yield batch.select(["a", "b"]).filter(pa.array(estimates(equal, a, b) >= least))

    side = lambda x: members.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size"))
    return map_arrow(met, passing, "a long, b long")


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts, and where each text's begin."""
    values, many = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for s in text_slices(column):
        owner, value = shingles(s.data, s.offsets)
        values.append(value)
        many.append(np.bincount(owner, minlength=s.last - s.first))
    return np.concatenate(values), np.cumsum(np.concatenate(many))


def _confirmed(pairs: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def similar(batches):
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for first in range(0, batch.num_rows, CONFIRM_ROWS):
                part = batch.slice(first, CONFIRM_ROWS)
                (a, a_at), (b, b_at) = _sets(part.column("a_text")), _sets(part.column("b_text"))
                rows = np.arange(part.num_rows, dtype=np.uint64)
                of = lambda value, at: chained(np.repeat(rows, np.diff(at)), value)
                both = segment_sums(np.isin(of(a, a_at), of(b, b_at)), a_at)
                keep.append(100 * both >= similarity * (np.diff(a_at) + np.diff(b_at) - both))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))

    side = lambda x: members.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), similar, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in a link; the component is its smallest
    node.  Large and small stars alternate until nothing changes; every round's
    links are written to the shared folder, and those before are deleted."""
    spark = links.sparkSession
    folder = shared_folder(spark, "links")
    own = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links", folder)
    before = None
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        last, folder = folder, shared_folder(spark, "stars")
        own = stored(small, "stars", folder)
        remove(spark, last)
        now = tuple(own.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


class _Members:
    """The members of a bucket that meet in one task: two blocks of it, or one."""

    def __init__(self, batch: pa.Table):
        column = lambda name: batch.column(name).to_numpy()
        self.node, self.component, self.size, self.block = (column(c) for c in ("node", "component", "size", "block"))
        self.sketch = _sketch_rows(batch.column("sketch").combine_chunks())
        self.bands = self.sketch.view(np.uint64)  # four registers are a band
        self.value, self.at = _sets(batch.column("text"))

    def links(self, band: int, similarity: int, least: float, apart: bool) -> list[tuple[int, int]]:
        """Links that join components of the bucket, one for each two that a
        member brings together, of pairs that meet in this band first.  Two
        blocks are ``apart``: pairs inside one of them are left to its own
        meeting."""
        label = self.component.copy()
        names, counts = np.unique(label, return_counts=True)
        largest = names[counts.argmax()]
        found = []
        for k in np.flatnonzero(self.component != largest):
            other = label != label[k]
            # two members outside the largest component are compared once
            other &= (self.component == largest) | (self.node > self.node[k])
            if apart:
                other &= self.block != self.block[k]
            other &= 100 * np.minimum(self.size, self.size[k]) >= similarity * np.maximum(self.size, self.size[k])
            at = np.flatnonzero(other)
            at = at[estimates((self.sketch[at] == self.sketch[k]).mean(1), self.size[at], self.size[k]) >= least]
            if len(at):
                at = at[(self.bands[at] == self.bands[k]).argmax(1) == band % self.bands.shape[1]]
            if not len(at):
                continue
            many = self.at[at + 1] - self.at[at]
            own = self.value[self.at[k] : self.at[k + 1]]
            both = segment_sums(np.isin(self.value[flat_ranges(self.at[at], many)], own), np.concatenate(([0], np.cumsum(many))))
            at = at[100 * both >= similarity * (many + len(own) - both)]
            for j in at[np.unique(label[at], return_index=True)[1]] if len(at) else ():
                found.append((int(self.node[k]), int(self.node[j])))
            for name in np.unique(label[at]):
                label[label == name] = label[k]
        return found


def _rest(buckets: DataFrame, labels: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between different components of a bucket, on full sets.  Only
    buckets of three and more members with several components come here.  Their
    members are dealt into blocks; each two blocks meet in one task, and each block
    meets itself in another.  A bucket of up to BLOCK members and BLOCK_SHINGLES
    shingles is one block."""
    least = least_estimate(similarity)
    labelled = buckets.filter("members > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled.join(members.select("node", "size"), "node").select("band", "node", "component", "size"), "labelled")
    mixed = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    mixed = stored(mixed.filter("low <> high").select("band", "blocks"), "mixed-buckets")
    placed = labelled.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    meetings = placed.withColumn("other", F.explode(others)).select("band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "component")
    dealt = meetings.join(members, "node").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "node")

    def compare(batches):
        def links(rows: pa.Table) -> pa.RecordBatch:
            band, x, y = (rows.column(c)[0].as_py() for c in ("band", "x", "y"))
            found = _Members(rows).links(band, similarity, least, x != y)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        kept, kept_key = [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "x", "y")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if first == last:
                    continue
                key = tuple(keys[first].tolist())
                if kept and key != kept_key:
                    yield links(pa.concat_tables(kept))
                    kept = []
                kept, kept_key = [*kept, table.slice(first, last - first)], key
        if kept:
            yield links(pa.concat_tables(kept))

    return map_arrow(dealt.select("band", "x", "y", "block", "node", "component", "size", "sketch", "text"), compare, "a long, b long")


def _members(buckets: DataFrame, classes: DataFrame, base: DataFrame) -> DataFrame:
    """(node, size, sketch, text) of the classes that share a bucket: what all
    comparing needs, read from the documents once.  Rows with the same id and text
    give one."""
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("doc").alias("doc_id"), "text_hash", "size", "sketch")
    found = base.filter(F.col("doc_id").isNotNull()).join(wanted, ["doc_id", "text_hash"])
    return found.groupBy("doc_id", "text_hash").agg(*[F.first(c).alias(c) for c in ("node", "size", "sketch", "text")]).select("node", "size", "sketch", "text")


def _same_id(with_set: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that one document id has."""
    key = F.struct("one", "two")
    several = with_set.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low <> high").select("doc_id")
    held = with_set.select("doc_id", "one", "two").join(several, "doc_id").distinct().join(classes.select("one", "two", "node"), ["one", "two"]).select("doc_id", "node")
    return held.join(held.groupBy("doc_id").agg(F.min("node").alias("first")), "doc_id").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))


def _judged(docs: DataFrame, similarity: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``near_duplicates``, and the table of sketches."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketches = stored(_sketches(base), "sketches")
    with_set = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = with_set.groupBy("one", "two").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.max("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    classes = stored(classes.select("one", "two", F.col("least.doc_id").alias("doc"), "least.text_hash", "size", "sketch"), "classes").select("*", row_number().alias("node"))

    bands = _bands(classes)
    hubs = stored(bands.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1"), "hubs")
    buckets = stored(bands.join(hubs, "band"), "buckets")
    members = stored(_members(buckets, classes, base), "members")
    pairs = buckets.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = _confirmed(_estimated(pairs, members, similarity), members, similarity)
    links = stored(stars.unionByName(_same_id(with_set, classes)), "star-links")
    labels = components(links)
    more = stored(_rest(buckets, labels, members, similarity), "rest-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = classes.select("node", "doc").join(labels, "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    of_class = classes.select("one", "two", "node", "doc").join(labels.join(named, "component").select("node", "component_id"), "node", "left").select("one", "two", F.coalesce("component_id", "doc").alias("component_id"))
    rows = with_set.select("doc_id", "n_shingles", "one", "two").join(of_class, ["one", "two"]).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = sketches.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return rows.unionByName(alone), sketches


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Texts without words (null and empty ones among them) are linked with
    nothing.  Rows with a null id are kept, with a null component, and linked
    with nothing, as a component is named by an id.  Rows with equal ids are one
    document: their different texts lie in one component.  Equal texts are always
    linked.  An empty table gives no rows.
    """
    return _judged(docs, similarity, id_col, text_col)[0]


def deduplicated(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, one document of each component: the one
    with the smallest id.  Rows with null ids stay; of rows with equal ids the one
    with the smallest hash of all columns stays."""
    rows, sketches = _judged(docs, similarity, "doc_id", "text")
    kept = rows.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").select(docs.columns)
    repeated = stored(sketches.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        several = known.join(repeated, "doc_id", "left_semi").select(docs.columns)
        whole = F.struct(*[F.col(c) for c in docs.columns])
        one = several.groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
        known = known.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one)
    return known.unionByName(docs.filter(F.col("doc_id").isNull()))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[k : k + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
), parts AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN parts USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
