"""The engine facade: index sites, index a page, stop, statistics, search.

The index is a `Store`: base tables and the changes since, so that putting in a
page writes that page and not the index.  The store's version and part are in the
search memo's key.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.analyzer import RUSSIAN, Analyzer, Dictionary, query_lemmas
from ..operators import crawl as crawling
from ..operators import live
from ..operators import search, snippet, stats, status
from ..sources import tables
from .store import Store, newest

#: Texts that callers see.
ALREADY_RUNNING = "Индексация уже запущена"
NOT_RUNNING = "Индексация не запущена"
NOT_LISTED = "Данная страница находится за пределами сайтов, указанных в конфигурационном файле"
EMPTY_QUERY = "Задан пустой поисковый запрос"
NOT_INDEXED = "Индексация не проведена"
NOTHING_FOUND = "Nothing was found for query "


def good() -> dict:
    return {"result": True}


def error(message: str) -> dict:
    return {"result": False, "error": message}


@dataclass
class Engine:
    """``folder`` holds the index; ``sites`` is a list of {url, name}.
    ``dictionary`` is a morphology table (form, lemma, pos, ord) or the path of
    one; without it the analyzer's own few forms are all.  A large one is compiled to
    an automaton; with ``guess`` any, and other forms get lemmas by their endings."""

    spark: SparkSession
    folder: str
    sites: list[dict]
    analyzer: Analyzer = RUSSIAN
    is_html: bool = True
    dictionary: DataFrame | str | None = None
    guess: bool = False
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _gate: threading.Lock = field(default_factory=threading.Lock)
    _stop: threading.Event = field(default_factory=threading.Event)
    _job: str | None = None
    _memo: tuple | None = None

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.folder)
        self.store.deciding = self._deciding
        morph = self.spark.read.parquet(self.dictionary) if isinstance(self.dictionary, str) else self.dictionary
        forms = Dictionary.seed(self.spark, self.analyzer) if morph is None else Dictionary.of(morph)
        self._forms = forms.compile(self.guess) if self.guess or not forms.small else forms

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def _config(self) -> DataFrame:
        rows = tables.site_list(self.spark, self.sites)
        return rows.select("site_url", "name", F.lit("INDEXING").alias("status"), F.current_timestamp().alias("status_time"), F.lit("").alias("last_error"))

    def _log(self, fetched: DataFrame) -> DataFrame:
        """(site_url, path, code, error, ts) of fetches with their site."""
        path = urls.stored_path(urls.relative_path(F.col("page_url"), F.col("site_url")))
        return fetched.select("site_url", path.alias("path"), "code", F.when(F.col("error").isNotNull(), status.page_error(F.col("page_url"), F.col("error"))).alias("error"), "ts")

    def _pages(self, fetched: DataFrame) -> DataFrame:
        """The last fetch of each page."""
        path = urls.stored_path(urls.relative_path(F.col("page_url"), F.col("site_url")))
        rows = fetched.filter(F.col("code").isNotNull()).select("site_url", path.alias("path"), "code", F.coalesce("body", F.lit("")).alias("content"), "ts")
        return newest(rows)

    # operations

    @contextmanager
    def _operation(self, wait: bool) -> Iterator[bool]:
        """The one operation under way, its jobs as a group that `stop` cancels; false
        where another is under way.  A stop and the commit decide by one lock which
        of them comes first."""
        if not self._lock.acquire(blocking=wait):
            yield False
            return
        context = self.spark.sparkContext
        try:
            with self._gate:
                self._stop.clear()
                self._job = f"index-{uuid.uuid4().hex}"
            context.setJobGroup(self._job, "indexing", interruptOnCancel=True)
            yield True
        finally:
            with self._gate:
                self._job = None
            context.setLocalProperty("spark.jobGroup.id", None)
            self._lock.release()

    @contextmanager
    def _deciding(self) -> Iterator[None]:
        """Where the store commits: not after a stop, and after it there is nothing
        left to stop."""
        with self._gate:
            if self._stop.is_set():
                raise InterruptedError(status.STOPPED_BY_USER)
            yield
            self._job = None

    def _run(self, work) -> dict:
        with self._operation(wait=False) as begun:
            if not begun:
                return error(ALREADY_RUNNING)
            try:
                return work()
            except Exception:
                if not self._stop.is_set():
                    raise
                return good()  # stopped: nothing of it counts

    def index_all(self, fetches: DataFrame, max_depth: int | None = None) -> dict:
        """Crawl ``fetches`` (page_url, code, content_type, body, error, ts) from
        the configured sites and build the index anew.  Where that fails or is
        stopped, the index stays as it was and its sites are FAILED."""
        return self._run(lambda: self._index_all(lambda sites: (crawling.crawl(sites, fetches, max_depth, self._stop.is_set), fetches)))

    def index_live(self, folder: str, max_depth: int | None = None, retries: int = 2, quota: int = 100, **options: str) -> dict:
        """The same with pages fetched now, by HTTP, from the configured sites.  The crawl
        is kept in ``folder``: after a failure or a stop the same folder goes on where it
        ended, a new folder begins anew.  Options are those of `sources.http`."""
        return self._run(lambda: self._index_all(lambda sites: live.crawl(sites, folder, max_depth, retries, quota, self._stop.is_set, **options)))

    def _index_all(self, gather: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> dict:
        """``gather`` gives the reached pages of sites and the fetches."""
        try:
            sites = self._config()
            reached, fetches = gather(sites)
            key = crawling.page_key(F.col("page_url")).alias("key")
            fetched = fetches.withColumn("key", key).join(reached.select("site_url", key).distinct(), "key").drop("key")
            if self._stop.is_set():
                raise InterruptedError(status.STOPPED_BY_USER)
            self.store.build(self._pages(fetched), status.fold_status(sites, self._log(fetched)), self.analyzer, self._forms, self.is_html)
        except Exception as e:  # noqa: BLE001  any failure is told by the sites' status
            # the jobs that tell it are not part of what was stopped
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            message = status.STOPPED_BY_USER if self._stop.is_set() else status.unexpected_error(str(e))
            self.store.mark(self._config().withColumns({"status": F.lit("FAILED"), "last_error": F.lit(message)}))
            return good() if self._stop.is_set() else error(message)
        return good()

    def stop(self) -> dict:
        """End a running operation: its jobs are cancelled, the index stays as it
        was before it.  Once it has committed there is none to stop."""
        with self._gate:
            if self._job is None:
                return error(NOT_RUNNING)
            self._stop.set()
            job = self._job
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(job)  # the group is this operation's alone
        return good()

    def index_page(self, url: str, fetches: DataFrame) -> dict:
        """Put in or replace the page ``url`` from its fetch."""
        known = [s["url"] for s in self.sites if (s["url"].rstrip("/") + "/").lower() in url.lower()]
        if not known:
            return error(NOT_LISTED)
        site = max(known, key=len)
        fetched = lambda: fetches.filter(urls.same_link(F.col("page_url"), F.lit(url))).withColumn("site_url", F.lit(site))
        return self._run(lambda: self._upsert(fetched(), site))

    def _upsert(self, fetched: DataFrame, *site_urls: str) -> dict:
        fetched = fetched.filter(urls.relative_path(F.col("page_url"), F.col("site_url")).isNotNull())
        old = self.table("sites")
        sites = old.unionByName(self._config().join(old.select("site_url"), "site_url", "left_anti").filter(F.col("site_url").isin(*site_urls)))
        touched = F.col("site_url").isin(*site_urls)
        # the home page may be an old one: it counts as fetched before
        home = self.table("pages").filter((F.col("path") == "/") & touched).select("site_url", "path", "code", F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("ts"))
        home = home.join(self._log(fetched).select("site_url", "path"), ["site_url", "path"], "left_anti")
        folded = status.fold_status(sites.filter(touched), self._log(fetched).unionByName(home))
        self.store.update(self._pages(fetched), sites.filter(~touched).unionByName(folded), self.analyzer, self._forms, self.is_html)
        return good()

    def apply_fetches(self, fetches: DataFrame) -> dict:
        """Put in or replace many pages at once, as a stream's batches bring them;
        fetches of no configured site are left out.  The last fetch of a page by
        ``ts`` wins, whichever batch brings it.  A stop in between raises, so that a
        stream brings the batch again."""
        with self._operation(wait=True):
            sites = tables.site_list(self.spark, self.sites)
            placed = fetches.join(crawling.site_of(fetches.select("page_url").distinct(), sites).filter("site_url IS NOT NULL"), "page_url")
            touched = [r[0] for r in placed.select("site_url").distinct().collect()]  # at most the configured sites
            return self._upsert(placed, *touched) if touched else good()

    def statistics(self) -> dict:
        """Totals and a row for each site; `result` false if they can't be had."""
        try:
            sites, counts, lemmas = (self.table(n) for n in ("sites", "counts", "lemmas"))
            total = stats.totals(sites, counts, lemmas).first().asDict()
            rows = [r.asDict() for r in stats.detailed(sites, counts, lemmas).orderBy("url").collect()]
        except Exception:  # noqa: BLE001  the contract: any failure is a false result
            return {"result": False}
        detailed = [{"statusTime" if k == "status_time" else k: v for k, v in r.items()} for r in rows]
        return {"result": True, "statistics": {"total": total, "detailed": detailed}}

    def search(self, query: str, site: str | None = None, offset: int = 0, limit: int = 10) -> dict:
        """A page of results.  The ranked list of the last query is kept, by the
        query in lower case, the site and the state of the index."""
        if not query.strip():
            return error(EMPTY_QUERY)
        if search.sites_not_indexed(self.table("sites"), site).first()[0]:
            return error(NOT_INDEXED)
        query = query.strip()
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        lemmas = [r.lemma for r in query_lemmas(asked, self.analyzer, self._forms).collect()]  # the words of one query
        wanted = self.spark.createDataFrame([(0, x) for x in lemmas], "query_id int, lemma string")
        key = (query.lower(), site, self.store.entry)
        if self._memo is None or self._memo[0] != key:
            if self._memo is not None:
                self._memo[1].unpersist()
            scope = (lambda df: df) if site is None else (lambda df: df.filter(F.col("site_url") == site))
            found = search.search(wanted, *(scope(self.table(n)) for n in ("lemmas", "postings", "counts")))
            self._memo = (key, found.persist())
        found = self._memo[1]
        top = search.result_page(found, offset, limit).collect()  # at most ``limit`` rows, or all if those are fewer
        if not top:
            return {"result": True, "error": NOTHING_FOUND + query, "count": 0, "data": []}
        of_top = F.lit(False)
        for r in top:
            of_top = of_top | ((F.col("site_url") == r.site_url) & (F.col("path") == r.path))
        names = self.table("sites").select("site_url", F.col("name").alias("site_name"))
        shown = text.clean_text(F.col("content")) if self.is_html else F.col("content")
        rows = self.table("pages").filter(of_top).join(names, "site_url").withColumn("shown", shown).persist()
        lemma, stops = self._forms.readings(rows.select(F.explode(self.analyzer.words(F.col("shown"))).alias("word")))
        snippets = snippet.snippet_column(F.col("shown"), F.array(*[F.lit(x) for x in lemmas]).cast("array<string>"), self.analyzer, lemma, stops)
        made = {(r.site_url, r.path): r for r in rows.select("site_url", "path", "site_name", text.html_title(F.col("content")).alias("title"), snippets.alias("snippet")).collect()}
        rows.unpersist()
        data = []
        for r in sorted(top, key=lambda r: r.place):
            page = made[r.site_url, r.path]
            data.append({"site": r.site_url, "siteName": page.site_name, "uri": r.path, "title": page.title, "snippet": page.snippet, "relevance": r.relevance})
        return {"result": True, "count": top[0].total, "data": data}


def to_json(response: dict) -> str:
    """A response as JSON, without fields that are null."""

    def known(x):
        if isinstance(x, dict):
            return {k: known(v) for k, v in x.items() if v is not None}
        return [known(v) for v in x] if isinstance(x, list) else x

    return json.dumps(known(response), ensure_ascii=False)
