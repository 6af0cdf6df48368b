import time

import numpy as np
import pytest

from tarnwell.llm import url_filter


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:at])
        path = rest[at:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    "https://example.com/en/7", "http://www.Example.COM/en/712?q#f", "https://com/en/", "https://xcom/en/", "https://a.b.net/de/8", "https://example.net/de/8", "https://m.example.net/de/88",
    "https://example.org/es/1", "https://example.org/es", "https://example.org#/es/", "ftp://x.org/es/", "no scheme/en/", "", None, "://", "https://", "https://example.com?/en/", "a://b://com/en/", "https://www.example.com/en/7\n8", "https://ÜBER.com/en/ä",
]


def test_rows_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(None, URLS[0], "y"), (0, URLS[0], "x")], "page_id long, url string, keys string")
    got = [tuple(r) for r in url_filter.judge(pages).collect()]
    assert len(got) == len(URLS) + 2
    assert sorted(map(str, got)) == sorted(map(str, [(k, *brute(u, url_filter.RULES)) for k, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])]]))
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules=[]).collect()} == {"allow"}
    with pytest.raises(ValueError, match="at most 1"):
        url_filter.judge(pages, max_listed=1)


def test_many_listed_keys(spark):
    rules = [(f"h{k}.example.com", f"/{'ab'[k % 2]}", "block" if k % 3 else "allow") for k in range(300)]
    urls = [f"https://{'www.' * (k % 2)}h{k % 600}.example.com/{'abc'[k % 3]}/x" for k in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(pages, rules).collect():
        assert tuple(r)[1:] == brute(urls[r.page_id], rules)


def test_urls_of_very_many_labels(spark):
    urls = ["https://" + "a." * 16_000 + "example.org/es/1", "https://" + "a." * 16_000 + "example.com/en/7" + "/x" * 50_000, "https://a..org/es/", "https://.org/es/", "https://org./es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages).collect()}
    assert got == {k: brute(u, url_filter.RULES) for k, u in enumerate(urls)} and time.time() - began < 60


@pytest.mark.parametrize("rate", [0.9, 0.5, 0.01])
def test_cascade_is_exact_over_the_universe(rate):
    rng = np.random.default_rng(1)
    one, two = (rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2))
    inside, outside = (one[:500], two[:500]), (one[500:], two[500:])
    first = url_filter._level(*inside, rate, 0)
    through = url_filter._passes(first, *outside)
    levels = url_filter.build(inside, (outside[0][through], outside[1][through]), first)
    assert url_filter.member(levels, *inside).all() and not url_filter.member(levels, *outside).any()
    assert through.any() and len(levels) > 1


def test_keys_of_one_first_half_are_told_apart(spark, monkeypatch):
    """All keys have the same first 64 bits."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(url_filter, "digest_of", lambda key: F.unhex(F.concat(F.lit("0123456789abcdef"), F.substring(F.sha2(key, 256), 1, 16))))
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert sorted(map(str, (tuple(r) for r in url_filter.judge(pages).collect()))) == sorted(str((k, *brute(u, url_filter.RULES))) for k, u in enumerate(URLS))
