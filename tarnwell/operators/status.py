"""Status of sites from the log of their fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that callers see.
HOME_NOT_ACCESSIBLE = "Главная страница сайта недоступна"
STOPPED_BY_USER = "Индексация прервана пользователем"


def unexpected_error(message: str) -> str:
    return f"Unexpected exception : {message}. See logs for more information."


def page_error(url: Column, message: Column) -> Column:
    return F.concat(F.lit("Ошибка при парсинге страницы "), url, F.lit(" -> "), message)


def home_accessible(pages: DataFrame) -> DataFrame:
    """(site_url, accessible): whether the home page is there with code 200."""
    return pages.groupBy("site_url").agg(F.coalesce(F.bool_or((F.col("path") == "/") & F.col("code").eqNullSafe(200)), F.lit(False)).alias("accessible"))


def fold_status(sites: DataFrame, log: DataFrame, cancelled: bool = False) -> DataFrame:
    """Sites after the fetches ``log`` (site_url, path, code, error, ts).  The
    first error that is no HTTP status makes a site FAILED, and so does a home
    page that is missing or not 200; a site that had FAILED stays so, and an old
    error stays where no new one comes.  ``cancelled`` fails all sites."""
    bad = F.col("error").isNotNull()
    facts = log.groupBy("site_url").agg(
        F.bool_or(bad).alias("any_error"),
        F.min_by("error", F.when(bad, F.struct("ts", "path", "error"))).alias("first_error"),
        F.bool_or((F.col("path") == "/") & F.col("code").eqNullSafe(200)).alias("home"),
        F.max("ts").alias("last_ts"),
    )
    out = sites.join(facts, "site_url", "left")
    failed = (F.col("status") == "FAILED") | F.coalesce("any_error", F.lit(False))
    no_home = ~F.coalesce("home", F.lit(False))
    status = F.when(failed | no_home, "FAILED").otherwise("INDEXED")
    # a site that had failed takes no new error from pages
    news = F.when(F.col("status") == "FAILED", F.lit("")).when(F.coalesce("any_error", F.lit(False)), F.col("first_error")).when(no_home, F.lit(HOME_NOT_ACCESSIBLE)).otherwise(F.lit(""))
    if cancelled:
        status, news = F.lit("FAILED"), F.lit(STOPPED_BY_USER)
    return out.select("site_url", "name", status.alias("status"), F.greatest("status_time", "last_ts").alias("status_time"), F.when(news != "", news).otherwise(F.col("last_error")).alias("last_error"))


def update_status(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """Sites after (site_url, status, status_time, error): status and time always
    change, the error only to one that is not empty."""
    new = changes.select("site_url", F.col("status").alias("s"), F.col("status_time").alias("t"), F.nullif(F.col("error"), F.lit("")).alias("e"))
    return sites.join(new, "site_url", "left").select("site_url", "name", F.coalesce("s", "status").alias("status"), F.coalesce("t", "status_time").alias("status_time"), F.coalesce("e", "last_error").alias("last_error"))


def finished(sites: DataFrame) -> DataFrame:
    """One row: whether every site is INDEXED or FAILED."""
    return sites.agg(F.coalesce(F.bool_and(F.col("status").isin("INDEXED", "FAILED")), F.lit(True)).alias("finished"))
