"""The crawl over real pages against a plain walk."""

import html
import re
from collections import defaultdict
from urllib.parse import urljoin

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.functions import matching
from tarnwell.functions.urls import FILE_ENDINGS
from tarnwell.operators import crawl
from tarnwell.plans import catalogue
from tarnwell.sources.tables import FETCHES


def key(url):
    return url.removesuffix("/").lower()


def test_a_link_finds_the_page_stored_with_a_slash(spark):
    row = lambda url, body: (url, 200, "text/html", body, None, None)
    corpus = spark.createDataFrame([row("https://s", '<a href="/x">x</a>'), row("https://s/X/", '<a href="/x/y">y</a>'), row("https://s/x/y", "end")], FETCHES)
    got = {(r.page_url, r.depth) for r in crawl.crawl(spark.createDataFrame([("https://s",)], "site_url string"), corpus).collect()}
    assert got == {("https://s", 0), ("https://s/x", 1), ("https://s/x/y", 2)}


def test_crawl_pages_equals_walk(spark):
    d = "/root/testdata/sf0.001"
    bodies = defaultdict(list)
    sites = set()
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        origin = re.match("https?://[^/?#]+", r.url)[0]
        sites.add(origin)
        bodies[key(r.url)].append((r.url, r.html))
        bodies[key(origin)].append((origin, r.html))

    def good(url):
        for page, body in bodies[key(url)]:
            for href in re.findall(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'>]*)["']""", body):
                link = urljoin(page, html.unescape(href).strip())
                if key(link).startswith(key(page)) and key(link) != key(page) and "#" not in link and not any(e in link.lower() for e in FILE_ENDINGS):
                    yield link

    expected = set()
    for site in sites:
        seen, frontier, depth = {key(site)}, [site], 0
        while frontier:
            expected |= {(site, page, depth) for page in frontier}
            found = {}
            for link in sorted(link for page in frontier for link in good(page)):
                if key(link) not in seen:
                    found.setdefault(key(link), link)
            seen |= set(found)
            frontier, depth = list(found.values()), depth + 1
    got = [(r.site_url, r.page_url, r.depth) for r in catalogue.QUERIES["crawl_pages"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert len(got) > len(sites)


SITES = ["https://a.b", "https://a.b/c/", "a.b", "A.b", "B/c", "https://other", "https://a.b", "x", "", "https://д.е", "https://a.b/c", None]
URLS = ["https://a.b/c/d", "https://a.b/", "https://a.b", "HTTPS://A.B/C/", "https://other.example/x/y", "https://Д.Е/ж", "nothing", "", "/", None, "q" * 300 + "x/", "y/" * 400 + "https://a.b/c/", "https://a.b/" + "z" * 70_000]


def sites_by_comparison(sites, pages):
    prefix = lambda s: s.lower() if s.endswith("/") else s.lower() + "/"
    return {p: max((s for s in sites if s is not None and p is not None and prefix(s) in p.lower()), key=lambda s: (len(s), s.encode()), default=None) for p in pages}


@pytest.mark.parametrize("limit", ["none", "bytes", "entries"])
def test_sites_equal_comparison(spark, monkeypatch, limit):
    """By the automaton, and by parts of urls where there are too many sites for one."""
    if limit == "bytes":
        monkeypatch.setattr(crawl, "MOST_BYTES", 2)
    if limit == "entries":
        monkeypatch.setattr(matching, "MOST_ENTRIES", 64)
    pages = URLS[:-1] if limit != "none" else URLS
    got = crawl.site_of(spark.createDataFrame([(u,) for u in pages + pages[:3]], "page_url string"), spark.createDataFrame([(s,) for s in SITES], "site_url string"))
    assert {r.page_url: r.site_url for r in got.collect()} == sites_by_comparison(SITES, pages)
    assert got.count() == len(pages)


def test_no_sites(spark):
    got = crawl.site_of(spark.createDataFrame([("https://a/",)], "page_url string"), spark.createDataFrame([], "site_url string"))
    assert [tuple(r) for r in got.collect()] == [("https://a/", None)]


@given(st.lists(st.text("ab/", max_size=6), max_size=12), st.lists(st.text("abc/", max_size=40), max_size=8), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_matcher_equals_search(strings, texts, stretch):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matching, "_STRETCH", stretch)
        got = matching.Matcher([s.encode() for s in strings]).highest(pa.array(texts, pa.string()))
    assert got.tolist() == [max((k for k, s in enumerate(strings) if s and s in t), default=-1) for t in texts]


def test_no_nested_loop(spark):
    pages = spark.createDataFrame([("https://a/",)], "page_url string")
    plan = crawl.site_of(pages, spark.createDataFrame([("https://a",)], "site_url string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
