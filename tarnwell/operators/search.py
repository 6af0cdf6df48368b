"""Ranked search, a batch of queries at a time; one query is a batch of one.

Per site, query lemmas that the site lacks or that stand on more than 90 % of its
good pages are not used; a page must have all that are left.  Its relevance is
the sum of their ranks, divided by the best of the query over all sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FREQUENCY_SHARE = 0.9


def frequency_limits(counts: DataFrame, share: float = FREQUENCY_SHARE) -> DataFrame:
    """(site_url, good_pages, frequency_limit) of (site_url, good_pages)."""
    return counts.select("site_url", "good_pages").withColumn("frequency_limit", F.floor(F.col("good_pages") * F.lit(share)).cast("int"))


def usable_lemmas(queries: DataFrame, lemmas: DataFrame, limits: DataFrame) -> DataFrame:
    """(query_id, site_url, lemma, frequency) of the lemmas a search uses.  The
    queries are few and filter the lemmas before anything touches postings."""
    present = lemmas.join(queries.select("query_id", "lemma"), "lemma")
    return present.join(limits, "site_url").filter("frequency <= frequency_limit").select("query_id", "site_url", "lemma", "frequency")


def rarest_lemmas(usable: DataFrame) -> DataFrame:
    """The rarest usable lemma of each query and site, first by name on ties."""
    best = usable.groupBy("query_id", "site_url").agg(F.min(F.struct("frequency", "lemma")).alias("best"))
    return best.select("query_id", "site_url", "best.lemma", "best.frequency")


def absolute_relevance(usable: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, site_url, path, abs_relevance) of the pages with every usable
    lemma: relational division, counted and summed in one pass."""
    needed = usable.groupBy("query_id", "site_url").agg(F.count("*").alias("needed"))
    found = usable.join(posts, ["site_url", "lemma"]).groupBy("query_id", "site_url", "path").agg(F.count("*").alias("found"), F.sum("rank").cast("float").alias("abs_relevance"))
    return found.join(needed, ["query_id", "site_url"]).filter("found = needed").select("query_id", "site_url", "path", "abs_relevance")


def with_relative(absolute: DataFrame) -> DataFrame:
    """Adds ``relevance`` (abs / best of the query) and ``total`` (pages found).
    Both come from a small aggregate, so no window gathers a query's pages."""
    best = absolute.groupBy("query_id").agg(F.max("abs_relevance").alias("best"), F.count("*").alias("total"))
    return absolute.join(best, "query_id").select("query_id", "site_url", "path", "abs_relevance", (F.col("abs_relevance") / F.col("best")).cast("float").alias("relevance"), "total")


MOST_WORDS = 1000


def search(queries: DataFrame, lemmas: DataFrame, posts: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, site_url, path, abs_relevance, relevance, total) of all pages
    that ``queries`` (query_id, lemma) find; not yet in order.  ``counts`` has the
    good pages of each site.  The words of a batch of queries are looked up first,
    if they are no more than MOST_WORDS, and become conditions of the scans."""
    words = [r[0] for r in queries.select("lemma").distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) <= MOST_WORDS:
        wanted = F.col("lemma").isin(words) if words else F.lit(False)
        lemmas, posts = lemmas.filter(wanted), posts.filter(wanted)
    usable = usable_lemmas(queries, lemmas, frequency_limits(counts))
    return with_relative(absolute_relevance(usable, posts))


def result_page(found: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of each query's results with their place (from 1), by descending
    relevance, then site and path.  The offset counts only if there are more
    results than ``limit``.  Top rows are picked per task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "site_url", "path")
    top = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= offset + limit)
    return top.filter((F.col("total") <= limit) | (F.col("place") > offset))


def sites_not_indexed(sites: DataFrame, site_url: str | None = None) -> DataFrame:
    """One row, whether any selected site is not indexed."""
    chosen = sites if site_url is None else sites.filter(F.col("site_url") == site_url)
    return chosen.agg(F.coalesce(F.bool_or(F.col("status") != "INDEXED"), F.lit(site_url is not None)).alias("not_indexed"))
