import random
import re

import pytest

from tarnwell.llm import decontaminate
from tarnwell.llm.common import text_slices

from .cases import by_id, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    lower = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = lower(text), set(), set()
    for name, item in items:
        own = lower(item)
        m = min(10, len(own))
        windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if m else set()
        for k in range(len(words) - m + 1 if m else 0):
            if tuple(words[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                names.add(name)
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_brute_force(seed):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "dd", "é", "x1"][: 2 + seed % 5]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200))) + rng.choice(["", ".", " -"]) for _ in range(30)]
    items = [(f"i{k:02}", ",".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 9, 10, 12, 25])))) for k in range(12)]
    items += [("copy", texts[0][5:90])]
    ids, words, tables = decontaminate.compile_patterns(items)
    (s,) = text_slices(pa.array(texts))
    h = decontaminate.hits_of(s.data, s.offsets, words, tables)
    for k, text in enumerate(texts):
        assert (h.n_words[k], h.n_hit[k], [ids[i] for i in h.items[np.flatnonzero(h.documents == k)]]) == brute(text, items)


BENCH = [(10, "Brown fox jumps over the lazy dog and then some"), (2, "lazy DOG"), (2, "lazy DOG"), (3, None), (4, ""), (None, "quick brown"), (5, "!!!"), (6, "漢字")]


def test_rows(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs(spark), bench))
    for doc_id, text in ((1, "quick"), (6, "QUICK")):
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (17, 10, 2, True), text
    import hashlib

    assert got[1].items_sha256 == hashlib.sha256(b"10,2").hexdigest()
    for doc_id in (2, 3, 4):
        assert (got[doc_id].n_words, got[doc_id].contaminated) == (0, False)
        assert got[doc_id].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].n_words == 240_000 and got[7].n_hit == 1
    kept = decontaminate.clean(docs(spark), bench)
    assert kept.columns == docs(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 8, 9, 9]


def test_empty_and_too_large(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    none = bench.limit(0)
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs(spark), none).filter("contaminated").count() == 0


def test_parts_equal_one_part(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 10, 14])))) for k in range(25)]
    rows = [(k % 37, " ".join(rng.choice(words) for _ in range(40)) + " " + rng.choice(items)[1] + " " + rng.choice(items)[1], None, None, None) for k in range(40)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), docs(spark, rows)
    assert len(decontaminate.pattern_parts(bench, part_bytes=200)) > 3
    got = sorted(tuple(r) for r in decontaminate.contamination(df, bench, part_bytes=200).collect())
    assert got == sorted(tuple(r) for r in decontaminate.contamination(df, bench).collect())
    wanted = sorted((d, *brute(t, [(str(k), x) for k, x in items])[:2]) for d, t, *_ in rows)
    assert [r[:3] for r in got] == wanted
    left = decontaminate.clean(df.filter("doc_id < 20"), bench.filter("length(text) > 20"), part_bytes=200)
    one = decontaminate.clean(df.filter("doc_id < 20"), bench.filter("length(text) > 20"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in one.collect())


def test_large_buckets_are_compared_in_bounds(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "EXPAND", 3)
    items = [(f"i{k}", f"a{k % 3} b{k % 5} " + "x y z " * 3) for k in range(15)]
    text = " ".join(t for _, t in items)
    _, words, tables = decontaminate.compile_patterns(items)
    (s,) = text_slices(pa.array([text]))
    h = decontaminate.hits_of(s.data, s.offsets, words, tables)
    assert (h.n_words[0], h.n_hit[0], len(h.items)) == tuple(x if isinstance(x, int) else len(x) for x in brute(text, items))


def test_tables_are_small():
    items = [(str(k), " ".join(f"w{k}x{j}" for j in range(200))) for k in range(200)]
    ids, words, tables = decontaminate.compile_patterns(items)
    size = sum(x.nbytes for x in words) + sum(x.nbytes for t in tables for x in t if hasattr(x, "nbytes"))
    assert size < 120 * 200 * 200
