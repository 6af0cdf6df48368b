"""Crawling an offline corpus of fetches, breadth first.

The links of good pages are taken once.  Each round joins the frontier with them
and drops what was visited.  The rounds are driven from the driver, the data are
not: links, frontier and visited set are tables in the shared folder, and only
whether the frontier is empty comes back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.html import page
from ..functions.matching import Matcher, TooLarge
from ..sources.scratch import shared_folder, stored

#: Content types whose links are followed.
LINK_TYPES = ["text/plain", "text/html", "text/xml", "application/xhtml+xml", "application/xml", "application/rtf"]


def has_links(content_type: Column) -> Column:
    found = F.lit(False)
    for kind in LINK_TYPES:
        found = found | F.lower(content_type).contains(kind)
    return F.coalesce(found, F.lit(False))


def links(fetches: DataFrame) -> DataFrame:
    """(page_url, link) of all links, absolute, each once for a page.  A page's
    ``base`` element is what its links start from."""
    good = fetches.filter(F.col("code").eqNullSafe(200) & has_links(F.col("content_type")))
    read = good.select("page_url", page(F.col("body")).alias("page"))
    base = F.when(F.col("page.base").isNull(), F.col("page_url")).otherwise(urls.resolve(F.col("page_url"), F.col("page.base")))
    # resolved inside the array: a later filter on the link then reads a generated
    # column and does not repeat this expression for each of its conditions
    found = F.transform("page.hrefs", lambda href: urls.resolve_href(F.col("base"), href))
    rows = read.withColumn("base", base).select("page_url", F.explode(F.array_distinct(found)).alias("link"))
    return rows.filter("link <> ''").distinct()


def good_links(fetches: DataFrame, strict_boundary: bool = False) -> DataFrame:
    """(page_url, link) of the links a crawler follows."""
    return links(fetches).filter(urls.is_good_link(F.col("page_url"), F.col("link"), strict_boundary))


def page_key(url: Column) -> Column:
    """What two urls of one page share."""
    return F.lower(urls.remove_trailing_slash(url))


def followed(fetches: DataFrame) -> DataFrame:
    """(key, link, link_key): the links a crawler follows from each page, by the
    page's key; what several stored forms of one url link to counts together."""
    found = good_links(fetches)
    return found.select(page_key(F.col("page_url")).alias("key"), "link", page_key(F.col("link")).alias("link_key")).distinct()


def frontier_step(frontier: DataFrame, visited: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_url, page_url) of pages first seen from ``frontier`` along ``edges``
    (of ``followed``).  Pages are met by key, so a link with a trailing slash finds
    the page without one."""
    own = frontier.select("site_url", page_key(F.col("page_url")).alias("key"))
    found = edges.join(own, "key").groupBy("site_url", "link_key").agg(F.min("link").alias("page_url"))
    known = visited.select("site_url", page_key(F.col("page_url")).alias("link_key"))
    return found.join(known, ["site_url", "link_key"], "left_anti").select("site_url", "page_url")


def crawl(sites: DataFrame, fetches: DataFrame, max_depth: int | None = None, cancelled=lambda: False) -> DataFrame:
    """(site_url, page_url, depth) of all pages reached from the sites' home
    pages; ``max_depth`` 0 takes the home pages only.  Pages are read once, for
    their links; the rounds join small tables of urls."""
    spark: SparkSession = sites.sparkSession
    root = shared_folder(spark, "crawl")
    schema = "site_url string, page_url string, depth int"
    frontier = sites.select("site_url", F.col("site_url").alias("page_url"))
    edges, depth = None, 0
    while True:
        frontier.select("site_url", "page_url", F.lit(depth).alias("depth")).write.parquet(f"{root}/visited/depth-{depth}")
        visited = spark.read.schema(schema).parquet(*[f"{root}/visited/depth-{k}" for k in range(depth + 1)])
        if cancelled() or depth == max_depth:
            return visited
        if edges is None:
            edges = stored(followed(fetches).repartitionByRange("key").sortWithinPartitions("key"), "edges")
        frontier = stored(frontier_step(visited.filter(F.col("depth") == depth), visited, edges), "frontier")
        if frontier.isEmpty():
            return visited
        depth += 1


#: Bytes of site urls that the driver takes to build an automaton of.
MOST_BYTES = 1 << 20


def site_of(page_urls: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_url, site_url): the configured site of each url, the longest that
    the url contains; null for none.  Sites of up to MOST_BYTES become an automaton, which
    is broadcast (64 MB at most) and reads each url once; beyond that urls meet sites
    by those of their parts that end before a slash."""
    listed = sites.filter("site_url IS NOT NULL").select("site_url", urls.site_prefix(F.col("site_url")).alias("sought")).distinct()
    asked = page_urls.select("page_url").distinct()
    # a site and its string are read together, so that is what is counted
    size = listed.agg(F.sum(F.octet_length("sought") + F.octet_length("site_url"))).first()[0] or 0
    if size <= MOST_BYTES:
        ranked = sorted(listed.collect(), key=lambda r: (len(r.site_url), r.site_url.encode()))
        try:
            return _by_automaton(asked, [r.site_url for r in ranked], Matcher([r.sought.encode() for r in ranked]))
        except TooLarge:
            pass
    low = F.lower("page_url")
    ends = F.filter(F.sequence(F.lit(1), F.length(low)), lambda k: F.substring(low, k, F.lit(1)) == "/")
    parts = F.array_distinct(F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), e), lambda k: F.substring(low, k, e - k + 1)))))
    met = asked.filter(F.length("page_url") > 0).select("page_url", F.explode(parts).alias("sought")).join(listed, "sought")
    best = met.groupBy("page_url").agg(F.max_by("site_url", F.struct(F.length("site_url"), "site_url")).alias("site_url"))
    return asked.join(best, "page_url", "left")


def _by_automaton(asked: DataFrame, names: list[str], matcher: Matcher) -> DataFrame:
    shared = asked.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), matcher))

    @F.arrow_udf("string")
    def site(low: pa.Array) -> pa.Array:
        names, matcher = shared.value
        found = matcher.highest(low)
        return names.take(pa.array(found, mask=found < 0))

    return asked.select("page_url", site(F.lower("page_url")).alias("site_url"))
