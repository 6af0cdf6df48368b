import datetime as dt
import http.server
import threading
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.analyzer import LATIN, MORPH_SCHEMA
from tarnwell.operators import crawl
from tarnwell.plans import engine as engine_module
from tarnwell.plans.engine import Engine, to_json
from tarnwell.plans.store import SCHEMAS, ConcurrentWrite, Store
from tarnwell.sources.scratch import create_new, read_text
from tarnwell.sources.tables import FETCHES
from tarnwell.streaming import fetch_stream, keep_index

T = dt.datetime(2024, 1, 1)
A, B = "https://a.example", "https://b.example"


def page(url, body, code=200, kind="text/html", error=None):
    return (url, code, kind, body, error, T)


CORPUS = [
    page(A, '<title>Home</title><a href="/x">x</a> <a href="/y/">y</a> <a href="/gone">g</a> <a href="/f.pdf">f</a> <a href="https://c.example/">c</a> horses'),
    page(f"{A}/x", "<title>X</title><a href='/x/deep'>d</a> horses and ponies run"),
    page(f"{A}/y/", "ponies ponies sleep"),
    page(f"{A}/x/deep", "cats sleep"),
    page(f"{A}/gone", "missing horses", code=404),
    page(f"{A}/unlinked", "unicorns"),
    page(B, "dogs bark at horses"),
]


def fetches(spark, rows):
    return spark.createDataFrame(rows, FETCHES)


@pytest.fixture
def engine(spark, tmp_path):
    own = Engine(spark, str(tmp_path / "index"), [{"url": A, "name": "Site A"}, {"url": B, "name": "Site B"}], analyzer=LATIN)
    assert own.index_all(fetches(spark, CORPUS)) == {"result": True}
    return own


def rows(engine, name):
    return sorted(tuple(r) for r in engine.table(name).collect())


def test_index_and_statistics(engine):
    answer = engine.statistics()
    assert answer["result"] and answer["statistics"]["total"] == {"sites": 2, "pages": 6, "lemmas": 10, "indexing": False}
    first = answer["statistics"]["detailed"][0]
    assert (first["url"], first["name"], first["status"], first["pages"]) == (A, "Site A", "INDEXED", 5)
    assert set(first) == {"url", "name", "status", "statusTime", "error", "pages", "lemmas"}
    assert not engine.table("pages").filter(F.col("path").contains("unlinked")).count()


def test_search(engine):
    answer = engine.search("Ponies")
    assert [(d["uri"], round(d["relevance"], 3)) for d in answer["data"]] == [("/y", 1.0), ("/x", 0.5)]
    assert answer["count"] == 2 and "<b>ponies</b>" in answer["data"][0]["snippet"]
    assert [d["title"] for d in answer["data"]] == ["", "X"]
    assert engine.search("ponies", site=A)["count"] == 2
    assert engine.search("ponies", offset=1, limit=1)["data"][0]["uri"] == "/x"
    assert engine.search("ponies", offset=5, limit=1) == {"result": True, "error": engine_module.NOTHING_FOUND + "ponies", "count": 0, "data": []}
    assert engine.search("  ") == {"result": False, "error": engine_module.EMPTY_QUERY}
    assert engine.search("horses", site="https://unknown")["error"] == engine_module.NOT_INDEXED
    assert engine.search("zebra")["count"] == 0
    assert "null" not in to_json(answer)


def test_index_page_equals_rebuild(spark, engine, tmp_path):
    assert engine.index_page("https://c.example/z", fetches(spark, CORPUS))["error"] == engine_module.NOT_LISTED
    new = [page(f"{A}/x", "zebras run")]
    assert engine.index_page(f"{A}/x", fetches(spark, new)) == {"result": True}
    again = Engine(spark, str(tmp_path / "index"), engine.sites, analyzer=LATIN)
    assert rows(again, "lemmas") == rows(engine, "lemmas")
    from tarnwell.operators import index

    posts = index.postings(engine.table("pages"), LATIN)
    assert sorted(tuple(r) for r in posts.collect()) == rows(engine, "postings")
    assert sorted(tuple(r) for r in index.frequencies(posts).collect()) == rows(engine, "lemmas")
    assert engine.search("zebras")["count"] == 1
    assert {r.site_url: r.status for r in engine.table("sites").collect()} == {A: "INDEXED", B: "INDEXED"}


def test_stop_and_running(engine):
    assert engine.stop()["error"] == engine_module.NOT_RUNNING
    with engine._operation(wait=False) as begun:
        assert begun and engine.stop() == {"result": True}
        assert engine.index_all(None)["error"] == engine_module.ALREADY_RUNNING
        assert engine.index_page(f"{A}/x", None)["error"] == engine_module.ALREADY_RUNNING


def test_failed_site_is_not_searched(spark, tmp_path):
    own = Engine(spark, str(tmp_path / "i"), [{"url": A, "name": "a"}], analyzer=LATIN)
    own.index_all(fetches(spark, [(A, None, None, None, "timeout", T)]))
    site = own.table("sites").first()
    assert site.status == "FAILED" and A in site.last_error and "timeout" in site.last_error
    assert own.search("x")["error"] == engine_module.NOT_INDEXED


def test_unexpected_failure_is_in_the_status(spark, tmp_path):
    own = Engine(spark, str(tmp_path / "i"), [{"url": A, "name": "a"}], analyzer=LATIN)
    answer = own.index_all(fetches(spark, CORPUS).withColumn("code", F.raise_error(F.lit("broken disk")).cast("int")))
    assert not answer["result"] and "broken disk" in answer["error"]
    site = own.table("sites").first()
    assert site.status == "FAILED" and site.last_error.startswith("Unexpected exception : ")
    assert own.statistics()["statistics"]["total"] == {"sites": 1, "pages": 0, "lemmas": 0, "indexing": False}


def test_a_failure_keeps_the_index(spark, engine):
    before = rows(engine, "postings"), rows(engine, "lemmas"), rows(engine, "pages")
    assert not engine.index_all(fetches(spark, CORPUS).withColumn("code", F.raise_error(F.lit("broken disk")).cast("int")))["result"]
    assert before == (rows(engine, "postings"), rows(engine, "lemmas"), rows(engine, "pages"))
    assert {r.status for r in engine.table("sites").collect()} == {"FAILED"}
    assert engine.index_all(fetches(spark, CORPUS)) == {"result": True}
    assert {r.status for r in engine.table("sites").collect()} == {"INDEXED"}


def test_stop_ends_the_running_jobs(spark, engine):
    before = rows(engine, "postings")

    @F.udf("string")
    def slow(body):
        time.sleep(60)
        return body

    answers = []
    run = threading.Thread(target=lambda: answers.append(engine.index_all(fetches(spark, CORPUS).withColumn("body", slow("body")))))
    began = time.time()
    run.start()
    while engine.stop() != {"result": True} or engine._job is None:
        time.sleep(0.1)
    time.sleep(2)
    engine.stop()
    run.join(40)
    assert not run.is_alive() and time.time() - began < 50 and answers == [{"result": True}]
    assert {(r.status, r.last_error) for r in engine.table("sites").collect()} == {("FAILED", engine_module.status.STOPPED_BY_USER)}
    assert rows(engine, "postings") == before


def test_updates_write_parts_and_are_folded_into_a_new_version(spark, engine, monkeypatch, tmp_path):
    version = engine.store.version
    for k in range(3):
        assert engine.index_page(f"{A}/x", fetches(spark, [page(f"{A}/x", f"zebra run number{'x' * k}")])) == {"result": True}
    assert (engine.store.version, engine.store.part) == (version, 3)
    assert [r.rank for r in engine.store.postings_by_page(A, "/x").orderBy("lemma").collect()] == [1.0, 1.0, 1.0]
    assert engine.search("numberxx")["count"] == 1 and engine.search("number")["count"] == 0
    kept = [rows(engine, n) for n in ("pages", "postings", "lemmas", "counts")]
    monkeypatch.setattr("tarnwell.plans.store.MAX_PARTS", 3)
    assert engine.index_page(f"{A}/x", fetches(spark, [page(f"{A}/x", "zebra run numberxx")])) == {"result": True}
    assert (engine.store.version, engine.store.part) == (version + 1, 0)
    assert kept == [rows(engine, n) for n in ("pages", "postings", "lemmas", "counts")]
    engine.index_all(fetches(spark, CORPUS))
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["log", f"v{version + 1}", f"v{version + 2}"]
    again = Engine(spark, str(tmp_path / "index"), engine.sites, analyzer=LATIN)
    assert (again.store.version, again.store.part) == (version + 2, 0) and rows(again, "lemmas") == rows(engine, "lemmas")


def test_delete_and_an_unfinished_part(spark, engine, tmp_path):
    engine.store._write(spark.createDataFrame([(A, "/y")], "site_url string, path string"), "touched", 1, "lost")  # as a lost driver leaves it
    again = Engine(spark, str(tmp_path / "index"), engine.sites, analyzer=LATIN)
    assert rows(again, "postings") == rows(engine, "postings")
    again.store.delete(spark.createDataFrame([(A, "/x")], "site_url string, path string"))
    assert (A, "/x") not in {r[:2] for r in rows(again, "pages")} and again.search("run")["count"] == 0
    from tarnwell.operators import index

    posts = index.postings(again.table("pages"), LATIN)
    assert sorted(tuple(r) for r in posts.collect()) == rows(again, "postings")
    assert sorted(tuple(r) for r in index.frequencies(posts).collect()) == rows(again, "lemmas")
    assert rows(again, "counts") == [(A, 4, 3), (B, 1, 1)]


def test_the_last_fetch_wins_whatever_batch_brings_it(spark, engine):
    old, new = T - dt.timedelta(days=1), T + dt.timedelta(days=1)
    row = lambda url, body, ts: (url, 200, "text/html", body, None, ts)
    engine.apply_fetches(fetches(spark, [row(f"{A}/x", "newest words", new), row(f"{B}/q", "first", T)]))
    engine.apply_fetches(fetches(spark, [row(f"{A}/x", "older words", old), row(f"{B}/q", "second", T), row(f"{B}/q", "third", old)]))
    assert [engine.search(w)["count"] for w in ("newest", "older", "first", "second", "third")] == [1, 0, 0, 1, 0]


def test_dictionary_table(spark, tmp_path):
    spark.createDataFrame([("ponies", "pony", "С", 0), ("and", "and", "СОЮЗ", 0), ("sleep", "sleep", "С", 0)], MORPH_SCHEMA).write.parquet(str(tmp_path / "morph"))
    own = Engine(spark, str(tmp_path / "i"), [{"url": A, "name": "a"}], analyzer=LATIN, dictionary=str(tmp_path / "morph"))
    own.index_all(fetches(spark, CORPUS))
    answer = own.search("pony")
    assert [d["uri"] for d in answer["data"]] == ["/y", "/x"] and "<b>ponies</b>" in answer["data"][0]["snippet"]
    assert own.search("ponies and")["count"] == 2


def test_search_reads_what_it_needs(spark, engine):
    from tarnwell.operators import search

    asked = spark.createDataFrame([(1, "ponies")], "query_id int, lemma string")
    plan = search.search(asked, *(engine.table(n) for n in ("lemmas", "postings", "counts")))._jdf.queryExecution().executedPlan().toString()
    assert "In(lemma, [ponies])" in plan or "EqualTo(lemma,ponies)" in plan
    assert "Generate" not in plan


def test_new_pages(spark):
    from tarnwell.operators import index

    made = index.new_pages(spark.createDataFrame([(f"{A}/x/", A), (A, A)], "page_url string, site_url string"))
    assert [tuple(r) for r in made.collect()] == [(A, "/x/", None, ""), (A, "/", None, "")]
    assert [r.path for r in index.saved_pages(made).collect()] == ["/x", "/"]
    with pytest.raises(Exception, match="is not a page of"):
        index.new_pages(spark.createDataFrame([(f"{B}/x/", A)], "page_url string, site_url string")).collect()


def test_depth_zero(spark):
    sites = spark.createDataFrame([(A,)], "site_url string")
    assert [r.page_url for r in crawl.crawl(sites, fetches(spark, CORPUS), max_depth=0).collect()] == [A]
    all_ = {(r.page_url, r.depth) for r in crawl.crawl(sites, fetches(spark, CORPUS)).collect()}
    assert all_ == {(A, 0), (f"{A}/x", 1), (f"{A}/y/", 1), (f"{A}/gone", 1), (f"{A}/x/deep", 2)}


def test_stream(spark, engine, tmp_path):
    fetches(spark, [page(f"{A}/new", "walrus"), page("https://c.example/", "none"), page(f"{B}/n", "walrus walrus")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = keep_index(engine, fetch_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), once=True)
    query.awaitTermination()
    assert {(d["site"], d["uri"]) for d in engine.search("walrus")["data"]} == {(A, "/new"), (B, "/n")}


def test_http_source(spark):
    from tarnwell.sources.http import fetch

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.path == "/"
            self.send_response(200 if good else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write("<p>привет".encode() if good else b"")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    got = {r.page_url: r for r in fetch(spark, [f"{at}/", f"{at}/no", "http://127.0.0.1:9/"], pauseMultiplier="1", pauseSummand="1").collect()}
    server.shutdown()
    assert (got[f"{at}/"].code, got[f"{at}/"].body) == (200, "<p>привет")
    assert got[f"{at}/no"].code == 404 and got[f"{at}/no"].error is None
    assert got["http://127.0.0.1:9/"].code is None and got["http://127.0.0.1:9/"].error


def deciding(engine, monkeypatch, before):
    """Stop just before or after the next commit; returns the answers."""
    inner, answers = engine._deciding, []

    @contextmanager
    def stopped():
        if before:
            answers.append(engine.stop())
        with inner():
            yield
        if not before:
            answers.append(engine.stop())

    monkeypatch.setattr(engine.store, "deciding", stopped)
    return answers


NEW = [(A, 200, "text/html", "<p>zebras only</p>", None, T)]


def test_stop_before_the_commit_keeps_the_index(spark, engine, monkeypatch):
    before, version = rows(engine, "postings"), engine.store.version
    answers = deciding(engine, monkeypatch, before=True)
    assert engine.index_all(fetches(spark, NEW)) == {"result": True} and answers == [{"result": True}]
    assert rows(engine, "postings") == before and engine.store.version == version
    assert {(r.status, r.last_error) for r in engine.table("sites").collect()} == {("FAILED", engine_module.status.STOPPED_BY_USER)}
    again = Engine(spark, engine.folder, engine.sites, analyzer=LATIN)
    assert rows(again, "postings") == before


def test_stop_after_the_commit_is_too_late(spark, engine, monkeypatch):
    answers = deciding(engine, monkeypatch, before=False)
    assert engine.index_all(fetches(spark, NEW)) == {"result": True}
    assert answers == [{"result": False, "error": engine_module.NOT_RUNNING}]
    assert {r.lemma for r in engine.table("lemmas").collect()} == {"zebras", "only"}
    assert {r.site_url: r.status for r in engine.table("sites").collect()}[A] == "INDEXED"


def test_stop_during_a_batch_of_updates(spark, engine):
    before, version = rows(engine, "postings"), (engine.store.version, engine.store.part)
    batch_rows = fetches(spark, [(f"{A}/x", 200, "text/html", "<p>zebras only</p>", None, T)])

    @F.udf("string")
    def slow(body):
        time.sleep(60)
        return body

    raised = []

    def batch():
        try:
            engine.apply_fetches(batch_rows.withColumn("body", slow("body")))
        except Exception as e:  # noqa: BLE001  a cancelled job has many names
            raised.append(e)

    run = threading.Thread(target=batch)
    run.start()
    while engine.stop() != {"result": True}:
        time.sleep(0.1)
    run.join(40)  # jobs that come after the stop don't run either
    assert raised and rows(engine, "postings") == before and (engine.store.version, engine.store.part) == version
    engine.apply_fetches(batch_rows)  # as a stream brings it again
    assert engine.search("zebras")["count"] == 1 and engine.stop()["error"] == engine_module.NOT_RUNNING


def test_of_two_writers_one_commits(spark, tmp_path):
    pages = lambda text: spark.createDataFrame([(A, "/x", 200, text, None)], "site_url string, path string, code int, content string, ts timestamp")
    sites = spark.createDataFrame([(A, "a", "INDEXED", None, "")], SCHEMAS["sites"])
    one = Store(spark, str(tmp_path / "i"))
    one.update(pages("first page"), sites, LATIN, is_html=False)  # an index begins with its first page
    other = Store(spark, str(tmp_path / "i"))
    one.update(pages("second page"), sites, LATIN, is_html=False)
    with pytest.raises(ConcurrentWrite):
        other.update(pages("third page"), sites, LATIN, is_html=False)
    for store in (one, other, Store(spark, str(tmp_path / "i"))):
        assert sorted(r.lemma for r in store.lemmas().collect()) == ["page", "second"]
    other.update(pages("fourth"), sites, LATIN, is_html=False)
    with pytest.raises(ConcurrentWrite):
        one.build(pages("fifth"), sites, LATIN, is_html=False)
    assert sorted(r.lemma for r in one.lemmas().collect()) == ["fourth"]


def test_a_file_is_created_once(spark, tmp_path):
    path, made = f"file://{tmp_path}/log/entry-1", []
    threads = [threading.Thread(target=lambda n=n: made.append((create_new(spark, path, str(n)), n))) for n in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [n for ok, n in made if ok] == [int(read_text(spark, path))] and len(made) == 8
    assert len(list((tmp_path / "log").iterdir())) <= 2  # the file and its checksum
