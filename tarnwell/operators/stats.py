"""Counts of an index by site and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pages_per_site(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site_url").agg(F.count("*").alias("pages"))


def good_pages_per_site(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site_url").agg(F.count_if(F.col("code").eqNullSafe(200)).alias("pages"))


def lemmas_per_site(lemmas: DataFrame) -> DataFrame:
    return lemmas.groupBy("site_url").agg(F.count("*").alias("lemmas"))


def totals(sites: DataFrame, counts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """One row: sites, pages (the sum of ``counts``: site_url, pages), lemmas (a
    lemma on two sites counts twice), and whether any site is being indexed.  Three
    one-row aggregates, side by side."""
    s = sites.agg(F.count("*").alias("sites"), F.coalesce(F.bool_or(F.col("status") == "INDEXING"), F.lit(False)).alias("indexing"))
    return s.crossJoin(counts.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))).crossJoin(lemmas.agg(F.count("*").alias("lemmas"))).select("sites", "pages", "lemmas", "indexing")


def detailed(sites: DataFrame, counts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """A row for each site; sites without pages have zeros."""
    out = sites.join(counts.select("site_url", "pages"), "site_url", "left").join(lemmas_per_site(lemmas), "site_url", "left")
    return out.select(
        F.col("site_url").alias("url"), "name", "status", F.unix_millis("status_time").alias("status_time"), F.col("last_error").alias("error"),
        F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("lemmas", F.lit(0)).alias("lemmas"),
    )
