"""Crawling live sites by HTTP, breadth first, kept in a folder and resumable.

A depth of the crawl is a table of pages to fetch, fetched in rounds: a round takes
up to ``quota`` pages of each host, those tried least first, so a host with millions of
pages keeps no task for longer than its quota takes, and what a lost round costs is
bounded.  A page that gave no answer, or one of RETRY_CODES, is tried again in a later
round, ``retries`` times.  When nothing is left the links of the depth's pages are taken
and the next depth begins, so depths are those of the offline crawl.

Every table is written once and counts when it is complete; a crawl that was cut short
goes on behind the last complete one.  Only "is this round's queue empty" reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.http import fetch_queues
from ..sources.scratch import kept
from ..sources.tables import FETCHES
from .crawl import followed, frontier_step, page_key

#: Answers that may be others at the next try.
RETRY_CODES = [429, 500, 502, 503, 504]

_VISITED = "site_url string, page_url string, depth int"
_TODO = "key string, host string, page_url string"
_QUEUE = "host string, page_url string, tries int"
_ROUND = f"{FETCHES}, tries int, final boolean"
_LINKS = "key string, link string, link_key string"


def _tables(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _queue(todo: DataFrame, rounds: DataFrame, quota: int) -> DataFrame:
    """The pages to ask next; ``tries`` says how often they were asked before."""
    tried = rounds.groupBy("page_url").agg(F.bool_or("final").alias("done"), F.count("*").cast("int").alias("tries"))
    left = todo.join(tried, "page_url", "left").filter(~F.coalesce("done", F.lit(False))).select("host", "page_url", F.coalesce("tries", F.lit(0)).alias("tries"))
    place = F.row_number().over(Window.partitionBy("host").orderBy("tries", "page_url"))
    return left.withColumn("place", place).filter(F.col("place") <= quota).drop("place")


def _round(queue: DataFrame, retries: int, options: dict[str, str]) -> DataFrame:
    fetched = fetch_queues(queue, queue.sparkSession.sparkContext.defaultParallelism, **options)
    again = F.col("code").isNull() | F.col("code").isin(*RETRY_CODES)
    return fetched.withColumn("final", ~again | (F.col("tries") >= retries))


def crawl(sites: DataFrame, folder: str, max_depth: int | None = None, retries: int = 2, quota: int = 100, cancelled: Callable[[], bool] = lambda: False, **options: str) -> tuple[DataFrame, DataFrame]:
    """(site_url, page_url, depth) of all pages reached from the sites' home pages, and
    their fetches.  A page that several sites hold is fetched once.  ``folder`` belongs
    to one crawl: sites and ``max_depth`` are those it began with.  Where ``cancelled``
    says so between two rounds, what there is so far is returned."""
    spark = sites.sparkSession
    visited, todos, links, rounds = [], [], [], []
    depth = 0

    def result() -> tuple[DataFrame, DataFrame]:
        return _tables(spark, _VISITED, visited), _tables(spark, _ROUND, rounds).filter("final").select("page_url", "code", "content_type", "body", "error", "ts")

    while True:
        home = f"{folder}/depth-{depth}"
        if depth == 0:
            found = sites.select("site_url", F.col("site_url").alias("page_url")).distinct()
        else:
            known = _tables(spark, _VISITED, visited)
            found = frontier_step(known.filter(F.col("depth") == depth - 1), known, _tables(spark, _LINKS, links))
        reached = kept(spark, f"{home}/visited", _VISITED, lambda: found.select("site_url", "page_url", F.lit(depth).alias("depth")))  # noqa: B023  called at once
        if reached.isEmpty():
            return result()
        visited.append(f"{home}/visited")
        asked = reached.groupBy(page_key(F.col("page_url")).alias("key")).agg(F.min("page_url").alias("page_url"))
        asked = asked.join(_tables(spark, _TODO, todos).select("key"), "key", "left_anti")
        todo = kept(spark, f"{home}/todo", _TODO, lambda: asked.select("key", F.lower(urls.origin(F.col("page_url"))).alias("host"), "page_url"))  # noqa: B023
        todos.append(f"{home}/todo")
        here: list[str] = []
        while True:
            if cancelled():
                return result()
            queue = kept(spark, f"{home}/queue-{len(here)}", _QUEUE, lambda: _queue(todo, _tables(spark, _ROUND, here), quota))  # noqa: B023
            if queue.isEmpty():
                break
            kept(spark, f"{home}/round-{len(here)}", _ROUND, lambda: _round(queue, retries, options))  # noqa: B023
            here.append(f"{home}/round-{len(here)}")
            rounds.append(here[-1])
        if depth == max_depth:
            return result()
        fetched = _tables(spark, _ROUND, here).filter("final")
        kept(spark, f"{home}/links", _LINKS, lambda: followed(fetched))  # noqa: B023
        links.append(f"{home}/links")
        depth += 1
