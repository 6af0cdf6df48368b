import heapq
import random
import zlib
from collections import Counter
from itertools import accumulate

from tarnwell.llm import sharding

from .cases import DOCS, docs


def plain(counts, n_shards):
    """The loads and each size's groups by shard, one heap step for each group."""
    heap, given = [(0, k) for k in range(n_shards)], {}
    for size in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        given.setdefault(size, [0] * n_shards)[k] += 1
    return [load for load, k in sorted(heap, key=lambda x: x[1])], given


def test_schedule_equals_heap():
    rng = random.Random(4)
    for n_shards in (1, 3, 24):
        for largest in (40, 4_000, 3_000_000_000):
            counts = {rng.randint(8, largest): rng.choice([1, 2, 7, 49, 500, 3000]) for _ in range(40)}
            order = sorted(counts, reverse=True)
            starts, shards, loads = sharding.schedule(order, [counts[s] for s in order], n_shards)
            wanted, given = plain(counts, n_shards)
            assert loads == wanted
            place, ends = 0, [*starts[1:].tolist(), sum(counts.values())]
            got = {s: [0] * n_shards for s in order}
            for start, end, shard in zip(starts.tolist(), ends, shards.tolist(), strict=True):
                size = next(s for s, upto in zip(order, accumulate(counts[s] for s in order), strict=True) if start < upto)
                got[size][shard] += end - start
                assert start == place
                place = end
            assert got == given


def test_shards_equal_heap_with_ties_and_a_hot_group(spark):
    rng = random.Random(6)
    texts = ["x" * rng.choice([0, 1, 5, 5, 5, 9000, 70_000]) + str(k // 2) for k in range(300)] + ["hot text"] * 400
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    settings = {"spark.sql.files.maxRecordsPerFile": "7"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sharding.shards(docs(spark, rows), 5).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    sizes = Counter()
    for t in texts:
        sizes[t] += len(t) + 8
    loads, given = plain(Counter(sizes.values()), 5)
    of_text, filled, seen = {}, [0] * 5, set()
    for r in got:
        of_text.setdefault(texts[r.doc_id], set()).add(r.shard)
        filled[r.shard] += r["size"]
        seen.add((r.shard, r.slot))
    assert filled == loads and all(len(x) == 1 for x in of_text.values()) and len(seen) == len(rows)
    assert all(sorted(s for k, s in seen if k == shard) == list(range(sum(k == shard for k, _ in seen))) for shard in range(5))
    placed = {}
    for t, (shard,) in of_text.items():
        placed.setdefault(sizes[t], [0] * 5)[shard] += 1
    assert placed == given


def test_rows(spark):
    got = sharding.shards(docs(spark), 3).collect()
    assert len(got) == len(DOCS)
    texts = {(d, t or "") for d, t, *_ in DOCS}
    for r in got:
        (text,) = [t for d, t in texts if d == r.doc_id]
        assert (r["size"], r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    assert len({r.shard for r in got if r.doc_id == 9}) == 1 and len({r.shard for r in got if r.doc_id in (2, 3)}) == 1
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shards(docs(spark, []), 3).count() == 0


def test_balance_of_the_query(spark):
    rows = sharding.op6_sharding(spark, "/root/testdata/sf0.01").toPandas()
    loads = rows.groupby("shard")["size"].sum()
    # whole texts can't be split: a shard exceeds the mean by less than the smallest texts differ, or holds one text
    assert len(loads) == 24 and loads.max() - loads.min() <= max(0.01 * loads.mean(), rows["size"].max() - loads.mean())
