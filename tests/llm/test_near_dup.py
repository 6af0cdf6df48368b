import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tarnwell.llm import near_dup
from tarnwell.llm.common import text_slices

from .cases import DOCS, SCHEMA, by_id, docs, twins

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {d: shingle_set(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(rng, n, words, edits, name):
    base = [f"{name}{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    for k in range(12):  # groups around the threshold, small and large sets, chains
        texts += family(rng, rng.choice([2, 5, 25]), rng.choice([3, 6, 8, 40, 120]), rng.choice([1, 3, 6]), f"g{k}")
    walk = [f"c{j}" for j in range(60)]
    for k in range(12):  # a chain whose ends are far apart
        walk[5 * k % 60] = f"n{k}"
        texts.append(" ".join(walk))
    rng.shuffle(texts)
    rows = [(k * 7 % 1009, t, None, None, None) for k, t in enumerate(texts)]
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_blocks_equal_one_block(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, t, None, None, None) for k, t in enumerate(family(rng, 90, 60, 6, "b"))]
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute(rows)


def test_rest_links_inside_blocks(spark, monkeypatch):
    """Buckets of three blocks whose hub is like nobody; each holds one pair that
    meets there first, in one block or in two."""
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    words = lambda k: [f"p{k}x{j}" for j in range(60)]
    rows = [(0, " ".join(words(0)), None, None, None)]
    for k in range(1, 13):
        rows += [(k, " ".join(words(k)), None, None, None), (100 + k, " ".join([*words(k)[:-1], "other"]), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    members = near_dup._sketches(df).join(df, ["doc_id", "text_hash"]).selectExpr("doc_id AS node", "n_shingles AS size", "sketch", "text").cache()
    keys = {}
    for r in near_dup._bands(members).collect():
        keys.setdefault(r.node, {})[r.band & 63] = r.band
    assert all(len(k) == 64 for k in keys.values())
    first = {k: next(keys[k][n] for n in range(64) if keys[k][n] == keys[100 + k][n]) for k in range(1, 13)}
    buckets = spark.createDataFrame([(band, node, 0, len(rows)) for band in first.values() for node in keys], "band long, node long, hub long, members long")
    labels = spark.createDataFrame([], "node long, component long")
    block = {r.node: r.block for r in members.selectExpr("node", "pmod(xxhash64(node), 3) AS block").collect()}
    assert {block[k] == block[100 + k] for k in first} == {True, False}
    got = near_dup._rest(buckets, labels, members, near_dup.SIMILARITY).collect()
    # all nodes were put into all buckets, so that a pair may meet in several of one place
    assert sorted({tuple(sorted((r.a, r.b))) for r in got}) == [(k, 100 + k) for k in first]


def test_blocks_are_bounded_in_shingles(spark, monkeypatch):
    rng = random.Random(18)
    rows = [(k, t, None, None, None) for k, t in enumerate(family(rng, 40, 60, 6, "s"))]
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 200)
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute(rows)


def test_rows_with_equal_ids_are_one_document(spark):
    rng = random.Random(4)
    (a, near_a), (b, near_b) = (list(family(rng, 2, 60, 1, name)) for name in "ab")
    rows = [(5, a), (5, b), (20, near_b), (21, near_a), (30, "quite another text of several words"), (5, a), (5, ""), (31, ""), (31, near_a)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    for parts in (1, 7):
        got = sorted((r.doc_id, r.n_shingles > 0, r.component_id) for r in near_dup.near_duplicates(df.repartition(parts)).collect())
        assert got == [(5, False, 5), (5, True, 5), (5, True, 5), (5, True, 5), (20, True, 5), (21, True, 5), (30, True, 30), (31, False, 31), (31, True, 5)]
        kept = near_dup.deduplicated(df.repartition(parts)).collect()
        assert sorted(r.doc_id for r in kept) == [5, 30, 31]
    assert len({tuple(map(tuple, sorted(near_dup.deduplicated(df.repartition(n)).collect()))) for n in (1, 3, 8)}) == 1


def test_words_that_a_polynomial_hash_confuses(spark):
    rows = [(k, f"{w} one two three four five", None, None, None) for k, w in enumerate(twins())]
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute(rows) == {0: (2, 0), 1: (2, 1)}


def test_registers_agree_with_jaccard():
    rng = np.random.default_rng(3)
    for size, shared in ((4, 3), (30, 20), (400, 320), (5000, 4000)):
        equal, n = [], 40
        for _ in range(n):
            values = rng.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
            a, b = values[:size], values[size - shared :]
            r = near_dup.registers(np.repeat([0, 1], size), np.concatenate((a, b)), 2)
            equal.append((r[0] == r[1]).mean())
        j = shared / (2 * size - shared)
        estimate = near_dup.estimates(np.array(equal), np.full(n, size), np.full(n, size))
        assert abs(estimate.mean() - j) < 4 * (j * (1 - j) / (n * min(256, size))) ** 0.5 + 0.01


def test_shingles_equal_sets():
    texts = [t for _, t, *_ in DOCS]
    for s in text_slices(pa.array(texts, pa.string())):
        owner, _ = near_dup.shingles(s.data, s.offsets)
        for k in range(s.first, s.last):
            assert (owner == k - s.first).sum() == len(shingle_set(texts[k]))


def test_rows(spark):
    got = near_dup.near_duplicates(docs(spark)).collect()
    assert len(got) == len(DOCS)
    own = {r.doc_id: (r.component_id, r.kept) for r in got}
    assert own == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (1, False), 7: (7, True), 8: (8, True), 9: (9, True), None: (None, True)}
    kept = near_dup.deduplicated(docs(spark))
    assert kept.columns == docs(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
