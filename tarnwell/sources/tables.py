"""Site lists and page tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

FETCHES = "page_url string, code int, content_type string, body string, error string, ts timestamp"


def site_list(spark: SparkSession, config: str | Path | list[dict]) -> DataFrame:
    """(site_url, name) of a list of {url, name}, or of a JSON or YAML file that
    has such a list under `indexing-settings.sites`."""
    if not isinstance(config, list):
        text = Path(config).read_text(encoding="utf-8")
        try:
            parsed = json.loads(text)
        except ValueError:
            import yaml  # only for YAML files

            parsed = yaml.safe_load(text)
        config = parsed["indexing-settings"]["sites"]
    return spark.createDataFrame([(s["url"], s["name"]) for s in config], "site_url string, name string")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys of duplicates that are broadcast.
FEW_KEYS = 100_000


def unique_pages(pages: DataFrame, order: str) -> DataFrame:
    """The first page, by ``order``, of each (site_url, path).  The duplicates are
    found on the keys alone and counted; contents are not shuffled where they are
    few."""
    keys = pages.groupBy("site_url", "path").agg(F.min(order).alias(order), F.count("*").alias("n")).filter("n > 1").select("site_url", "path", F.col(order).alias("first"))
    n = keys.limit(FEW_KEYS + 1).count()
    if not n:
        return pages
    return pages.join(F.broadcast(keys) if n <= FEW_KEYS else keys, ["site_url", "path"], "left").filter(F.col("first").isNull() | (F.col("first") == F.col(order))).drop("first")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `pages` as (page_id, url, site_url, path, code, content): the
    site of a page is its origin."""
    rows = load(spark, sf_dir, "pages").withColumn("site_url", urls.origin(F.col("url")))
    path = urls.stored_path(urls.relative_path(F.col("url"), F.col("site_url")))
    return rows.select("page_id", "url", "site_url", path.alias("path"), F.lit(200).alias("code"), F.col("html").alias("content"))


def document_pages(spark: SparkSession, sf_dir: str, all_good: bool = True) -> DataFrame:
    """The table `documents` as pages: a site for each source.  Where
    ``all_good`` is false, every 17th document has code 404."""
    code = F.lit(200) if all_good else F.when(F.col("doc_id") % 17 == 0, 404).otherwise(200)
    return load(spark, sf_dir, "documents").select(F.col("source").alias("site_url"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), code.alias("code"), F.col("text").alias("content"))
