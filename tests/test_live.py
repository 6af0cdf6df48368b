"""The crawl by HTTP against the offline crawl of the same pages."""

import http.server
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.analyzer import LATIN
from tarnwell.operators import crawl, live
from tarnwell.plans.engine import Engine
from tarnwell.sources.tables import FETCHES

PAGES = {
    "/": '<title>Home</title><a href="/x">x</a> <a href=y/>y</a> <a href="/gone">g</a> <a href="/f.pdf">f</a> <a href="/busy">b</a> <a href="/picture">p</a> horses',
    "/x": "<a href='/x/deep'>d</a> <a href='/x/broken'>b</a> horses and ponies run",
    "/y/": "ponies ponies sleep",
    "/x/deep": "<a href='/x/deep/er'>d</a> cats sleep",
    "/x/deep/er": "<a href='/'>home</a> the end",
    "/busy": "came at the third try",
    "/picture": "<a href='/picture/below'>not followed</a>",
}


class Site:
    """A server that counts what it is asked and how many ask it at once."""

    def __init__(self, busy=2):
        self.asked, self.now, self.most, self.busy = Counter(), 0, 0, busy
        site, lock = self, threading.Lock()

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                with lock:
                    site.asked[self.path] += 1
                    site.now += 1
                    site.most = max(site.most, site.now)
                time.sleep(0.01)
                code = 503 if self.path == "/busy" and site.asked[self.path] <= site.busy else 500 if self.path == "/x/broken" else 200 if self.path in PAGES else 404
                with lock:
                    site.now -= 1
                self.send_response(code)
                self.send_header("Content-Type", "image/png" if self.path == "/picture" else "text/html; charset=utf-8")
                self.end_headers()
                self.wfile.write(PAGES[self.path].encode() if code == 200 else b"")

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def corpus(self, spark):
        row = lambda path, code: (self.url + path.removesuffix("/") if path == "/" else self.url + path, code, "image/png" if path == "/picture" else "text/html", PAGES.get(path, ""), None, None)
        return spark.createDataFrame([row(p, 200) for p in PAGES] + [row("/gone", 404), row("/x/broken", 500)], FETCHES)


@pytest.fixture
def site():
    made = Site()
    yield made
    made.server.shutdown()


FAST = {"pauseMultiplier": "2", "pauseSummand": "1"}


def test_tables_equal_those_of_the_offline_corpus(spark, tmp_path, site):
    sites = [{"url": site.url, "name": "S"}]
    offline = Engine(spark, str(tmp_path / "offline"), sites, analyzer=LATIN)
    assert offline.index_all(site.corpus(spark)) == {"result": True}
    online = Engine(spark, str(tmp_path / "online"), sites, analyzer=LATIN)
    assert online.index_live(str(tmp_path / "crawl"), quota=2, **FAST) == {"result": True}
    for name, columns in [("pages", ["site_url", "path", "code", "content"]), ("lemmas", ["*"]), ("postings", ["*"]), ("sites", ["site_url", "status", "last_error"])]:
        got, expected = (sorted(map(str, e.table(name).select(*columns).collect())) for e in (online, offline))
        assert got == expected and got
    assert site.most == 1  # never asked twice at the same time
    assert site.asked["/busy"] == 3 and site.asked["/x/broken"] == 3
    assert all(n == 1 for path, n in site.asked.items() if path not in ("/busy", "/x/broken"))
    assert "/f.pdf" not in site.asked and "/picture/below" not in site.asked


def test_a_cut_crawl_goes_on(spark, tmp_path, site):
    sites = spark.createDataFrame([(site.url,)], "site_url string")
    expected = {(r.page_url.rstrip("/"), r.depth) for r in crawl.crawl(sites, site.corpus(spark)).collect()}
    folder = str(tmp_path / "crawl")
    for most in range(2, 60, 4):  # more questions before each stop
        calls = 0

        def cancelled(most=most):
            nonlocal calls
            calls += 1
            return calls > most

        reached, fetches = live.crawl(sites, folder, quota=3, cancelled=cancelled, **FAST)
        if calls <= most:
            break
    assert {(r.page_url.rstrip("/"), r.depth) for r in reached.collect()} == expected
    assert fetches.count() == fetches.select("page_url").distinct().count() == len(expected)
    assert all(n == 1 for path, n in site.asked.items() if path not in ("/busy", "/x/broken"))
    asked = site.asked.total()
    live.crawl(sites, folder, quota=3, **FAST)
    assert site.asked.total() == asked  # all of it was there


def test_hosts_share_their_pauses_and_depth_ends(spark, tmp_path):
    several = [Site(busy=0) for _ in range(3)]
    sites = spark.createDataFrame([(s.url,) for s in several] + [("http://127.0.0.1:9",)], "site_url string")
    reached, fetches = live.crawl(sites, str(tmp_path / "crawl"), max_depth=1, retries=0, **FAST)
    for s in several:
        s.server.shutdown()
        assert {r.page_url.removeprefix(s.url) for r in reached.filter(F.col("site_url") == s.url).collect()} == {"", "/x", "/y/", "/gone", "/busy", "/picture"}
        assert "/x/deep" not in s.asked and s.most == 1
    dead = fetches.filter(F.col("page_url") == "http://127.0.0.1:9").collect()
    assert len(dead) == 1 and dead[0].code is None and dead[0].error


def test_no_sites(spark, tmp_path):
    reached, fetches = live.crawl(spark.createDataFrame([], "site_url string"), str(tmp_path / "crawl"))
    assert reached.collect() == [] and fetches.collect() == []
