"""The stream of statuses against the fold of the whole log."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.operators.status import fold_status
from tarnwell.streaming.status import LOG, NOTHING, follow, merge

T = dt.datetime(2024, 1, 1)


def at(k):
    return T + dt.timedelta(seconds=k)


SITES = [("a", "A", "INDEXING", T, ""), ("b", "B", "FAILED", T, "old"), ("c", "C", "INDEXING", at(900), "older"), ("d", "D", "INDEXED", T, "x"), ("e", "E", "FAILED", T, "kept"), ("f", None, "INDEXING", None, None)]
ENTRIES = [
    ("a", "/x", None, "second", at(5)), ("a", "/y", None, "first", at(3)), ("a", "/z", None, "at no time", None), ("a", "/", 200, None, at(1)),
    ("b", "/", 200, None, at(9)), ("b", "/x", None, "not taken", at(8)),  # FAILED stays, with its error
    ("c", "/", 200, None, at(2)), ("c", "/x", 404, None, at(3)), ("c", "/", 500, None, at(4)),  # a status is no error
    ("d", "/x", 200, None, at(2)), ("d", None, None, None, None),  # no home page
    ("f", "/", 200, None, None), ("f", "/p", None, "", at(7)), ("f", "/p", None, "é", at(7)), ("f", "/p", None, "\U0001f600", at(7)),
    ("other", "/", 200, None, at(1)), (None, "/", 200, None, at(1)),
]


@pytest.mark.parametrize("seed", range(3))
def test_any_split_equals_the_fold(spark, tmp_path, seed):
    """In any order and any batches, some of them twice, over two starts of the query."""
    sites = spark.createDataFrame(SITES, "site_url string, name string, status string, status_time timestamp, last_error string")
    expected = sorted(map(str, fold_status(sites, spark.createDataFrame(ENTRIES, LOG)).collect()))
    rng = random.Random(seed)
    entries = ENTRIES + rng.sample(ENTRIES, 6)  # replayed
    rng.shuffle(entries)
    cuts = sorted(rng.sample(range(len(entries)), 3))
    for start in range(2):
        for k, (a, b) in enumerate(list(zip([0, *cuts], [*cuts, len(entries)], strict=True))[2 * start : 2 * start + 2]):
            spark.createDataFrame(entries[a:b], LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"{start}{k}"))
        got = follow(sites, str(tmp_path / "in" / "*"), str(tmp_path), files_at_once=1)
    assert sorted(map(str, got.collect())) == expected


FACT = st.tuples(st.none() | st.integers(0, 3), st.none() | st.sampled_from("ab"), st.none() | st.sampled_from(["", "x", "y"]), st.booleans(), st.none() | st.integers(0, 3)).map(lambda f: f if f[2] is not None else (None, None, *f[2:]))


@given(FACT, FACT, FACT)
@settings(max_examples=300, deadline=None)
def test_facts_merge_in_any_order(a, b, c):
    assert merge(a, merge(b, c)) == merge(merge(a, b), c)
    assert merge(a, b) == merge(b, a)
    assert merge(a, a) == a == merge(a, NOTHING) == merge(NOTHING, a)
