"""Sharding (operator 6): longest-processing-time scheduling of groups.

Documents with equal texts form a group that must stay together.  Groups sorted
by size, largest first, go to the least-loaded shard through a heap.

The schedule needs only how many groups there are of each size, so the driver
gets that histogram, not the groups.  Different sizes add up: with d of them the
texts have at least d * d / 2 bytes, so 100 TB have at most 14 million (and texts
of up to 100 kB at most 100,000 among those that are no copies).  Equal groups go
to the heap in one step where there are many: the shards are filled to a common
level that whole numbers give exactly as single steps would.

Which shard a group gets follows from its place in the order of sizes; the plan is
a table of the places where the shard changes, cut by the files of the sorted
groups and merged into them by a window over each file.  Groups and documents get
their places from range-sorted files: the place in a file plus the rows of the
files before it, so no task holds a whole shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import file_number, stored


def _level(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each shard has had when all loads below
    the highest possible level are filled up to it; fewer than there are shards
    are left after that."""
    low, high = min(loads), max(loads) + size * count
    while low < high:  # the highest level that takes no more than there are
        level = (low + high + 1) // 2
        taken = sum(max(0, -((x - level) // size)) for x in loads)
        low, high = (level, high) if taken <= count else (low, level - 1)
    return [max(0, -((x - low) // size)) for x in loads]


def schedule(sizes: list[int], counts: list[int], n_shards: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """LPT over groups of distinct sizes, largest first (ties between shards go to
    the lower number): the places in the order of sizes from which on groups go to
    another shard, those shards, and the loads."""
    heap = [(0, k) for k in range(n_shards)]
    starts, shards, place = [], [], 0
    for size, count in zip(sizes, counts, strict=True):
        given = [0] * n_shards
        if count > 2 * n_shards:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            given = _level(loads, size, count)
            heap = [(load + n * size, k) for k, (load, n) in enumerate(zip(loads, given, strict=True))]
            heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            given[k] += 1
        for k, n in enumerate(given):
            if n:
                starts.append(place)
                shards.append(k)
                place += n
    loads = [0] * n_shards
    for load, k in heap:
        loads[k] = load
    return np.array(starts, np.int64), np.array(shards, np.int32), loads


def _plan(spark: SparkSession, files: list[tuple[int, int]], starts: np.ndarray, shards: np.ndarray) -> DataFrame:
    """(file, place, shard): in each file of the sorted groups, given with its
    number of rows, the first place and those where the shard changes."""
    number = np.array([f for f, _ in files], np.int64)
    first = np.cumsum([0, *(n for _, n in files)])[:-1]
    opening = np.searchsorted(starts, first, side="right") - 1
    inside = np.searchsorted(first, starts, side="right") - 1
    later = starts != first[inside]
    table = {
        "file": np.concatenate((number, number[inside[later]])),
        "place": np.concatenate((np.zeros(len(number), np.int64), (starts - first[inside])[later])),
        "shard": np.concatenate((shards[opening], shards[later])),
    }
    return spark.createDataFrame(pa.table(table))


def shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard and slot.

    Null texts count as empty (size 8, crc32 0) and share the group of empty
    texts.  Repeated rows and null ids are rows like others, with slots of their
    own.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    rows = stored(rows, "shard-rows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = stored(groups.repartitionByRange(n, F.desc("bytes"), "key").sortWithinPartitions(F.desc("bytes"), "key"), "shard-groups")
    groups = groups.select("key", "bytes", file_number().alias("file"), F.col("_metadata.row_index").alias("place"))

    histogram = sorted((tuple(r) for r in groups.groupBy("bytes").agg(F.count("*")).collect()), reverse=True)
    files = sorted(tuple(r) for r in groups.groupBy("file").agg(F.count("*")).collect())
    starts, of_place, _ = schedule([b for b, _ in histogram], [c for _, c in histogram], n_shards)
    if files:
        changes = _plan(spark, files, starts, of_place).withColumn("key", F.lit(None).cast("binary"))
        before = Window.partitionBy("file").orderBy("place", F.col("key").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        merged = groups.select("file", "place", "key", F.lit(None).cast("int").alias("shard")).unionByName(changes)
        of_key = merged.withColumn("shard", F.last("shard", ignorenulls=True).over(before)).filter("key IS NOT NULL").select("key", "shard")
    else:
        of_key = groups.select("key", F.lit(0).alias("shard"))
    placed = rows.join(of_key, "key").repartitionByRange(n, "shard", "key", "doc_id").sortWithinPartitions("shard", "key", "doc_id")
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard"), "shard-slots").select("*", file_number().alias("file"), F.col("_metadata.row_index").alias("place"))
    counts = sorted(tuple(r) for r in placed.groupBy("shard", "file").agg(F.count("*"), F.min("place")).collect())
    offsets, seen = [], [0] * n_shards
    for shard, file, count, lowest in counts:
        offsets.append((shard, file, seen[shard] - lowest))
        seen[shard] += count
    # as many rows as files, plus one for each shard that begins inside a file
    offsets = F.broadcast(spark.createDataFrame(offsets, "shard int, file long, shift long"))
    return placed.join(offsets, ["shard", "file"]).select("doc_id", "size", "text_crc32", "shard", (F.col("shift") + F.col("place")).alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shards(docs, 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
