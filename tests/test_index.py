import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.functions.analyzer import LATIN, Dictionary
from tarnwell.operators import index, search, stats, status
from tarnwell.plans import store as store_module
from tarnwell.plans.store import SCHEMAS, Store, merge_from
from tarnwell.sources import unique_pages

PAGES = "site_url string, path string, code int, content string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def table(df):
    return sorted(tuple(r) for r in df.collect())


def test_postings_and_frequencies(spark):
    posts = index.postings(pages(spark, [("s", "/a", 200, "<p>one two two</p>"), ("s", "/b", 200, "two"), ("s", "/c", 404, "one"), ("s", "/d", None, "one"), ("s", "/e", 200, ""), ("s", "/f", 200, None)]), LATIN)
    assert table(posts) == [("s", "/a", "one", 1.0), ("s", "/a", "two", 2.0), ("s", "/b", "two", 1.0)]
    assert table(index.frequencies(posts)) == [("s", "one", 1), ("s", "two", 2)]


def test_increase_and_decrease(spark):
    lemmas = spark.createDataFrame([("s", "five", 5), ("s", "last", 1)], "site_url string, lemma string, frequency int")
    key = lambda *names: spark.createDataFrame([("s", n) for n in names], "site_url string, lemma string")
    assert table(index.increase(lemmas, key("five", "new"))) == [("s", "five", 6), ("s", "last", 1), ("s", "new", 1)]
    assert table(index.decrease(lemmas, key("five", "last", "absent"))) == [("s", "five", 4)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["ab", "cd", "ef", "gh"]), min_size=1, max_size=6), st.lists(st.sampled_from(["ab", "xy"]), max_size=5))
def test_increments_then_decrements_change_nothing_and_update_equals_rebuild(spark, old, new):
    start = pages(spark, [("s", "/a", 200, " ".join(old)), ("s", "/b", 200, "ab cd")])
    posts = index.postings(start, LATIN)
    lemmas = index.frequencies(posts)
    keys = lemmas.select("site_url", "lemma")
    assert table(index.decrease(index.increase(lemmas, keys), keys)) == table(lemmas)
    change = pages(spark, [("s", "/a", 200, " ".join(new))])
    updated = index.upsert_pages(start, posts, lemmas, change, LATIN)
    rebuilt = index.postings(updated[0], LATIN)
    assert table(updated[1].select(rebuilt.columns)) == table(rebuilt)
    assert table(updated[2]) == table(index.frequencies(rebuilt))


def test_lookups(spark):
    rows = pages(spark, [("https://s", "/path", 200, ""), ("https://s", "/", 200, "")])
    paths = lambda df: [r.path for r in df.collect()]
    assert paths(index.page_by_path(rows, "https://s", "/path/")) == ["/path"]
    assert paths(index.page_by_url(rows, "https://s", "https://s/path/")) == ["/path"]
    assert paths(index.page_by_url(rows, "https://s", "https://s")) == ["/"]
    assert paths(index.page_by_url(rows, "https://s", "https://other/path/")) == []


def test_update_parse_info(spark):
    old = pages(spark, [("s", "/a", None, ""), ("s", "/b", 404, "old")])
    new = pages(spark, [("s", "/a", 200, "content"), ("s", "/b", None, "")])
    assert table(index.update_parse_info(old, new)) == [("s", "/a", 200, "content"), ("s", "/b", 404, "old")]


def _search(spark, rows, query):
    asked = spark.createDataFrame([(1, w) for w in query.split()], "query_id int, lemma string")
    own = pages(spark, rows)
    posts = index.postings(own, LATIN)
    return search.search(asked, index.frequencies(posts), posts, Store._counts_of(own))


def test_frequency_ceiling(spark):
    # one page: the limit is 0; two: 1; ten: 9
    assert _search(spark, [("s", "/a", 200, "one")], "one").count() == 0
    two = [("s", "/a", 200, "one"), ("s", "/b", 200, "two")]
    assert [r.path for r in _search(spark, two, "one").collect()] == ["/a"]
    ten = [("s", f"/{k}", 200, "all" if k else "all few") for k in range(10)]
    assert _search(spark, ten, "all").count() == 0
    assert [(r.path, r.relevance) for r in _search(spark, ten, "all few").collect()] == [("/0", 1.0)]


def test_absent_lemma_is_dropped_per_site_and_relevance_is_global(spark):
    rows = [("s", "/a", 200, "one one two"), ("s", "/b", 200, "zz"), ("t", "/a", 200, "one"), ("t", "/b", 200, "zz")]
    got = {(r.site_url, r.path): (r.abs_relevance, round(r.relevance, 4)) for r in _search(spark, rows, "one two").collect()}
    assert got == {("s", "/a"): (3.0, 1.0), ("t", "/a"): (1.0, 0.3333)}


def test_paging_partitions_the_result(spark):
    rows = [("s", f"/{k}", 200, "one " * (k % 3 + 1)) for k in range(9)] + [("s", f"/z{k}", 200, "zz") for k in range(5)]
    found = _search(spark, rows, "one")
    page = lambda o, n: [r.path for r in search.result_page(found, o, n).orderBy("place").collect()]
    assert page(0, 4) + page(4, 4) + page(8, 4) == page(0, 20) == page(3, 9)  # the offset is ignored if all fit
    assert page(20, 4) == []
    relevance = [r.relevance for r in found.collect()]
    assert max(relevance) == 1 and min(relevance) > 0


SITES = "site_url string, name string, status string, status_time timestamp, last_error string"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def test_status_fold(spark):
    sites = spark.createDataFrame([(s, s, "FAILED" if s == "sticky" else "INDEXING", T0, "old" if s == "sticky" else "") for s in ("good", "bad", "homeless", "notfound", "sticky", "empty")], SITES)
    log = spark.createDataFrame(
        [("good", "/", 200, None, T1), ("good", "/x", 404, None, T1), ("bad", "/", 200, None, T0), ("bad", "/x", None, "second", T1), ("bad", "/y", None, "first", T0),
         ("homeless", "/x", 200, None, T1), ("notfound", "/", 404, None, T1), ("sticky", "/", 200, None, T1)],
        "site_url string, path string, code int, error string, ts timestamp",
    )
    got = {r.site_url: (r.status, r.last_error) for r in status.fold_status(sites, log).collect()}
    home = status.HOME_NOT_ACCESSIBLE
    assert got == {"good": ("INDEXED", ""), "bad": ("FAILED", "first"), "homeless": ("FAILED", home), "notfound": ("FAILED", home), "sticky": ("FAILED", "old"), "empty": ("FAILED", home)}
    stopped = {r.last_error for r in status.fold_status(sites, log, cancelled=True).collect()}
    assert stopped == {status.STOPPED_BY_USER}
    accessible = {r.site_url: r.accessible for r in status.home_accessible(log).collect()}
    assert accessible["good"] and not accessible["notfound"] and not accessible["homeless"]


def test_status_update_keeps_error(spark):
    sites = spark.createDataFrame([("a", "a", "INDEXING", T0, "kept"), ("b", "b", "INDEXING", T0, "kept")], SITES)
    changes = spark.createDataFrame([("a", "FAILED", T1, ""), ("b", "FAILED", T1, "very serious error")], "site_url string, status string, status_time timestamp, error string")
    assert {(r.site_url, r.status, r.status_time, r.last_error) for r in status.update_status(sites, changes).collect()} == {("a", "FAILED", T1, "kept"), ("b", "FAILED", T1, "very serious error")}
    assert status.finished(sites).first()[0] is False


def test_statistics_of_a_site_without_pages(spark):
    sites = spark.createDataFrame([("a", "A", "INDEXING", T0, "")], SITES)
    none = Store._counts_of(spark.createDataFrame([], PAGES))
    lemmas = spark.createDataFrame([], "site_url string, lemma string, frequency int")
    assert tuple(stats.totals(sites, none, lemmas).first()) == (1, 0, 0, True)
    row = stats.detailed(sites, none, lemmas).first()
    assert (row.pages, row.lemmas, row.status_time) == (0, 0, int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    assert F is not None


def test_parts_are_merged_in_levels():
    """1,000 updates of a page each: what is written, counted in pages."""
    weights, written, most = [], 0, 0
    for _ in range(1000):
        weights.append(1)
        written += 1
        while (start := merge_from(weights)) is not None:
            weights[start:] = [sum(weights[start:])]
            written += weights[-1]
        most = max(most, len(weights))
    assert sum(weights) == 1000 and most <= 3 * 5 + 1
    assert written <= 1000 * (1 + 5)  # once at first and once a level: 4 ** 5 > 1000
    assert merge_from([]) is None and merge_from([64, 1, 1, 1]) is None and merge_from([64, 1, 0, 1, 2]) == 1


def test_merged_parts_say_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FANOUT", 2)
    sites = spark.createDataFrame([("https://s", "s", "INDEXED", None, "")], SCHEMAS["sites"])
    page = lambda *rows: spark.createDataFrame([("https://s", p, code, text, None) for p, code, text in rows], "site_url string, path string, code int, content string, ts timestamp")
    store = Store(spark, str(tmp_path / "i"))
    store.build(page(("/a", 200, "alpha beta"), ("/b", 200, "beta"), ("/c", 404, "gone")), sites, LATIN, is_html=False)
    for rows in ([("/a", 200, "beta gamma")], [("/d", 200, "delta")], [("/a", 404, "nothing"), ("/c", 200, "gamma")], [("/b", 200, "beta beta")]):
        store.update(page(*rows), sites, LATIN, is_html=False)
    store.delete(page(("/d", 200, "")).select("site_url", "path"), sites)
    assert len(store.parts) <= 4
    final = Store(spark, str(tmp_path / "j"))
    final.build(page(("/a", 404, "nothing"), ("/b", 200, "beta beta"), ("/c", 200, "gamma")), sites, LATIN, is_html=False)
    for name in ("pages", "postings", "lemmas", "counts", "sites"):
        of = [sorted(map(str, s.table(name).collect())) for s in (store, Store(spark, str(tmp_path / "i")), final)]
        assert of[0] == of[1] == of[2], name


FETCHED = "site_url string, path string, code int, content string, ts timestamp"


def _exchanged(df) -> str:
    """The plan of a query, with the columns that are exchanged."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_stand_in_the_pages_rows_without_an_exchange(spark):
    rows = pages(spark, [("s", "/a", 200, "one two two and"), ("s", "/b", 404, "one"), ("s", "/c", 200, None), ("s", "/d", None, "x y")])
    made = index.with_terms(rows, LATIN, is_html=False)
    assert "Exchange" not in _exchanged(made)
    assert {r.path: sorted(map(tuple, r.terms or [])) for r in made.collect()} == {"/a": [("one", 1.0), ("two", 2.0)], "/b": [], "/c": [], "/d": []}


def test_terms_by_every_kind_of_dictionary(spark):
    rows = pages(spark, [("s", "/a", 200, "cats cat the dogs"), ("s", "/b", 200, "dogs dog cow the the")])
    forms = spark.createDataFrame([("cats", "cat", False), ("dogs", "dog", False), ("the", None, True), ("cow", None, False)], "form string, known string, stop boolean")
    small = Dictionary(forms, small=True)
    want = [("s", "/a", "cat", 2.0), ("s", "/a", "dog", 1.0), ("s", "/b", "cow", 1.0), ("s", "/b", "dog", 2.0)]
    for dictionary in (small, Dictionary(forms, small=False), Dictionary(forms, small=False).compile()):
        assert table(index.postings(rows, LATIN, dictionary, is_html=False)) == want
        made = index.with_terms(rows, LATIN, dictionary, is_html=False).select("site_url", "path", F.explode("terms").alias("t"))
        assert table(made.select("site_url", "path", "t.lemma", "t.rank")) == want


def test_rows_of_one_key_add_up_in_a_store(spark, tmp_path):
    sites = spark.createDataFrame([("s", "s", "INDEXED", None, "")], SCHEMAS["sites"])
    store = Store(spark, str(tmp_path / "i"))
    store.build(spark.createDataFrame([("s", "/a", 200, "one two", None), ("s", "/a", 200, "two", None), ("s", "/b", 200, "two", None)], FETCHED), sites, LATIN, is_html=False)
    posts = [("s", "/a", "one", 1.0), ("s", "/a", "two", 2.0), ("s", "/b", "two", 1.0)]
    assert table(store.postings()) == posts and table(store.postings_by_page("s", "/a")) == posts[:2]
    assert table(store.lemmas()) == [("s", "one", 1), ("s", "two", 2)]
    older = Store(spark, store.folder)
    store.update(spark.createDataFrame([("s", "/a", 200, "new", None)], FETCHED), sites, LATIN, is_html=False)
    assert table(store.lemmas()) == [("s", "new", 1), ("s", "two", 1)]
    assert table(older.lemmas()) == [("s", "one", 1), ("s", "two", 2)]  # a reader stays at its state


def test_few_keys_shuffle_neither_pages_nor_postings(spark, tmp_path):
    """Of tables too large to be broadcast themselves."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = pages(spark, [("s", f"/{n}", 200, "one two") for n in range(9)])
        posts = index.postings(start, LATIN)
        posts.write.parquet(str(tmp_path / "posts"))
        posts = spark.read.parquet(str(tmp_path / "posts"))
        left = index.delete_pages(start, posts, index.frequencies(posts), start.filter("path = '/3'"))
        assert all("SortMergeJoin" not in _exchanged(df) for df in left)
        assert left[0].count() == 8 and table(left[2]) == [("s", "one", 8), ("s", "two", 8)]
        twice = start.withColumn("page_id", F.monotonically_increasing_id())
        assert "Join" not in _exchanged(unique_pages(twice, "page_id"))
        assert "SortMergeJoin" not in _exchanged(unique_pages(twice.union(twice.limit(1)), "page_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
