"""The queries of the site index and the same queries as DuckDB SQL.

Pages come from the table `pages` (site: the origin of the url) or from
`documents` (site: the source), words from the Latin profile.  Queries on an index
read a `Store` that the first of them builds; queries on building one don't.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.analyzer import LATIN, LATIN_STOP, RUSSIAN, RUSSIAN_DOUBLED, Dictionary, lemmas_of_words, query_lemmas
from ..operators import crawl, index, search, snippet, stats, status
from ..sources import document_pages, load, page_rows, unique_pages
from ..sources.scratch import shared_folder, stored
from ..streaming.status import follow
from . import catalogue_text
from .engine import NOTHING_FOUND, to_json
from .store import Store

QUERY_ROWS = [(1, "the of"), (2, "la les"), (3, "the ing"), (4, "der sch")]
ONE_SITE, ONE_LEMMA, ONE_DOC = "src1", "the", "/1"
LIMIT = 10
#: Latin letters and the Cyrillic ones that stand for them.
_LATIN_LETTERS, _CYRILLIC_LETTERS = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"


# Spark side

def _docs(spark: SparkSession, d: str) -> DataFrame:
    return document_pages(spark, d)


def _site_pages(spark: SparkSession, d: str) -> DataFrame:
    return unique_pages(page_rows(spark, d), "page_id")


def _doc_posts(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_docs(spark, d), LATIN, is_html=False)


def _page_posts(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_site_pages(spark, d), LATIN)


_stores: dict[tuple[str, str, str], Store] = {}


def _store(spark: SparkSession, d: str, kind: str = "documents") -> Store:
    """The index of a table, built once for a Spark application."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _stores:
        store = Store(spark, shared_folder(spark, "index"))
        pages = _docs(spark, d) if kind == "documents" else _site_pages(spark, d)
        pages = pages.select("site_url", "path", "code", "content", F.lit(None).cast("timestamp").alias("ts"))
        store.build(pages, _sites(pages), LATIN, is_html=kind == "pages")
        _stores[key] = store
    return _stores[key]


def _queries(spark: SparkSession) -> DataFrame:
    return query_lemmas(spark.createDataFrame(QUERY_ROWS, "query_id int, query string"), LATIN)


def _sites(pages: DataFrame) -> DataFrame:
    """A site table whose status follows from the name: sites with an even number
    of letters are indexed, others are being indexed."""
    state = F.when(F.length("site_url") % 2 == 0, "INDEXED").otherwise("INDEXING")
    return pages.select("site_url").distinct().select("site_url", F.upper("site_url").alias("name"), state.alias("status"), F.timestamp_millis(F.length("site_url") * 1000).alias("status_time"), F.lit("").alias("last_error"))


def url_normalize(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").select("page_id", urls.remove_trailing_slash(u).alias("url"), urls.origin(u).alias("origin"), urls.absolute_url(urls.origin(u), urls.relative_path(u, urls.origin(u))).alias("again"))


def url_relative_path(spark, d):
    return page_rows(spark, d).select("page_id", "site_url", "path", urls.is_home_path(F.col("path")).alias("is_home"))


def url_is_file_link(spark, d):
    ending = F.element_at(F.array(*[F.lit(x) for x in ["", ".PDF", "/a.docx?x", ".png", ".html"]]), (F.col("page_id") % 5 + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", urls.is_file_link(F.concat("url", ending)).alias("is_file"))


def url_page_in_site(spark, d):
    site = F.element_at(F.array(*[F.lit(x) for x in ["https://www.ththon.example.org", "http://blog.tionsh.example.com/", "example.com", "EXAMPLE.ORG/en"]]), (F.col("page_id") % 4 + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", urls.page_in_site(site, F.col("url")).alias("in_site"), urls.same_link(site, F.col("url")).alias("same"))


def site_of_page(spark, d):
    sites = page_rows(spark, d).select("site_url").distinct().filter(F.length("site_url") % 2 == 0)
    return crawl.site_of(load(spark, d, "pages").select(F.col("url").alias("page_url")), sites)


def _fetches(spark, d):
    return load(spark, d, "pages").select(F.col("url").alias("page_url"), F.lit(200).alias("code"), F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").alias("body"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds("page_id").alias("ts"))


def page_links(spark, d):
    return crawl.links(_fetches(spark, d))


def page_good_links(spark, d):
    """As if every page stood at its site's root, which is where links go down."""
    at_root = _fetches(spark, d).withColumn("page_url", urls.origin(F.col("page_url")))
    return crawl.good_links(at_root)


def page_link_counts(spark, d):
    return page_links(spark, d).groupBy("page_url").agg(F.count("*").alias("n_links"))


def acceptable_content(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ["text/html; charset=utf-8", "TEXT/PLAIN", "image/png", "application/xhtml+xml", "application/json"]]), (F.col("page_id") % 5 + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", crawl.has_links(kind).alias("has_links"))


def page_title(spark, d):
    return load(spark, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


def page_clean_text_len(spark, d):
    clean = text.clean_text(F.col("html"))
    return load(spark, d, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest"))


def fold_yo(spark, d):
    letters = F.translate("text", "eE", "ёЁ")
    return load(spark, d, "documents").select("doc_id", F.md5(text.fold_yo(letters)).alias("digest"))


def tokenize_documents(spark, d):
    words = index.words_of(_docs(spark, d), LATIN, is_html=False)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def token_stopword_filter(spark, d):
    words = index.words_of(_docs(spark, d), LATIN, is_html=False).groupBy("site_url", "word").agg(F.count("*").alias("n"))
    return lemmas_of_words(words, Dictionary.seed(spark, LATIN)).select("site_url", "lemma", "n")


def double_letter_strip(spark, d):
    """The Russian profile's words, doubled letters included, of all documents with
    their Latin letters taken for Cyrillic ones."""
    words = RUSSIAN.words(F.translate(F.lower(F.coalesce("text", F.lit(""))), _LATIN_LETTERS, _CYRILLIC_LETTERS))
    return load(spark, d, "documents").select("doc_id", words.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


def term_frequency(spark, d):
    return _doc_posts(spark, d)


def page_term_frequency(spark, d):
    return _page_posts(spark, d)


def term_frequency_good_pages(spark, d):
    """Pages that aren't 200 are stored but not indexed."""
    posts = index.postings(document_pages(spark, d, all_good=False), LATIN, is_html=False)
    return posts.groupBy("site_url", "path").agg(F.count("*").alias("lemmas"), F.sum("rank").cast("long").alias("words"))


def fetched_pages(spark, d):
    """Pages with a code; every 17th has 404, every 5th none."""
    pages = document_pages(spark, d, all_good=False)
    pages = pages.withColumn("code", F.when(F.substring("path", 2, 100).cast("long") % 5 != 0, F.col("code")))
    return index.fetched_pages(pages).select("site_url", "path", "code")


def document_frequency(spark, d):
    return index.frequencies(_doc_posts(spark, d))


def dictionary_frequency(spark, d):
    """Words through a dictionary table: a plural in s is its singular, its second
    reading counts for nothing, and words of four letters in n are prepositions.  The
    words are read once and stored, as the table asks for them several times."""
    words = stored(index.words_of(_docs(spark, d), LATIN, is_html=False).select(F.col("word").alias("form")).distinct(), "words")
    plural = words.filter("length(form) > 3 AND form LIKE '%s'")
    singular = F.expr("left(form, length(form) - 1)")
    row = lambda rows, lemma, pos, n: rows.select("form", lemma.alias("lemma"), F.lit(pos).alias("pos"), F.lit(n).alias("ord"))
    preposition = row(words.filter("length(form) = 4 AND form LIKE '%n'"), F.col("form"), "ПРЕДЛ", 1)
    morph = row(plural, singular, "С", 0).unionByName(row(plural, F.lit("other"), "С", 1)).unionByName(preposition)
    posts = index.postings(_docs(spark, d), LATIN, Dictionary.of(morph), is_html=False)
    return posts.groupBy("site_url", "lemma").agg(F.sum("rank").cast("long").alias("words"), F.count("*").alias("pages"))


def lemma_lookup(spark, d):
    return index.lemma_row(_store(spark, d).lemmas(), ONE_SITE, ONE_LEMMA)


def postings_by_lemma(spark, d):
    return index.postings_by_lemma(_store(spark, d).postings(), ONE_SITE, ONE_LEMMA)


def _one_page(spark, d):
    """The site of the one document."""
    return load(spark, d, "documents").filter(f"doc_id = {ONE_DOC[1:]}").select("source").first()[0]


def postings_by_page(spark, d):
    return _store(spark, d).postings_by_page(_one_page(spark, d), ONE_DOC)


def posting_by_lemma_page(spark, d):
    return index.posting(_store(spark, d).postings(), _one_page(spark, d), ONE_DOC, ONE_LEMMA)


def _page_zero(spark, d):
    return page_rows(spark, d).filter("page_id = 0").select("url", "site_url", "path").first()


def page_lookup(spark, d):
    page = _page_zero(spark, d)
    return index.page_by_path(_store(spark, d, "pages").pages(), page.site_url, page.path).select("site_url", "path", "code", F.md5("content").alias("digest"))


def page_lookup_url(spark, d):
    page = _page_zero(spark, d)
    return index.page_by_url(_store(spark, d, "pages").pages(), page.site_url, page.url).select("site_url", "path", "code", F.md5("content").alias("digest"))


def page_constructor(spark, d):
    """New pages of urls, and the path each is saved by."""
    made = index.new_pages(load(spark, d, "pages").select(F.col("url").alias("page_url"), urls.origin(F.col("url")).alias("site_url")))
    saved = urls.stored_path(F.col("path"))
    return made.select("site_url", "path", "code", "content", saved.alias("saved_path"))


def pages_per_site(spark, d):
    return stats.pages_per_site(document_pages(spark, d, all_good=False))


def responsive_pages_per_site(spark, d):
    return stats.good_pages_per_site(document_pages(spark, d, all_good=False))


def index_counts(spark, d):
    """The pages of each site as a built index counts them."""
    return _store(spark, d, "pages").counts()


def lemmas_per_site(spark, d):
    return stats.lemmas_per_site(_store(spark, d).lemmas())


def stats_total(spark, d):
    store = _store(spark, d)
    return stats.totals(store.sites(), store.counts(), store.lemmas())


def stats_detailed(spark, d):
    store = _store(spark, d)
    return stats.detailed(store.sites(), store.counts(), store.lemmas())


def _page_search(spark, d):
    store = _store(spark, d, "pages")
    return _queries(spark), store.lemmas(), store.postings(), store.counts()


def _doc_search(spark, d, site=None):
    store = _store(spark, d)
    scope = (lambda df: df) if site is None else (lambda df: df.filter(F.col("site_url") == site))
    return _queries(spark), scope(store.lemmas()), scope(store.postings()), scope(store.counts())


def lemma_frequency_limit(spark, d):
    return search.frequency_limits(_store(spark, d, "pages").counts())


def usable_query_lemmas(spark, d):
    q, lemmas, _, counts = _page_search(spark, d)
    return search.usable_lemmas(q, lemmas, search.frequency_limits(counts))


def rarest_query_lemma(spark, d):
    return search.rarest_lemmas(usable_query_lemmas(spark, d))


def search_abs_relevance(spark, d):
    q, lemmas, posts, counts = _page_search(spark, d)
    return search.absolute_relevance(search.usable_lemmas(q, lemmas, search.frequency_limits(counts)), posts)


def _to_places(number: Column, places: int) -> Column:
    """A double rounded as binary numbers are: what lies at a half only in its decimal
    digits, such as 0.38835, goes where its nearest double times the power of ten lies."""
    return F.round(number * 10.0**places) / 10.0**places


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "site_url", "path", "abs_relevance", _to_places(F.col("relevance").cast("double"), 6).alias("relevance"), "total")


def search_ranked_all_sites(spark, d):
    return _rounded(search.search(*_doc_search(spark, d)).filter("query_id = 1"))


def search_ranked_one_site(spark, d):
    return _rounded(search.search(*_doc_search(spark, d, ONE_SITE)).filter("query_id = 1"))


def search_page2(spark, d):
    page = search.result_page(search.search(*_doc_search(spark, d)), offset=LIMIT, limit=LIMIT)
    return page.select("query_id", "place", "site_url", "path")


def search_total_count(spark, d):
    return search.search(*_doc_search(spark, d)).groupBy("query_id").agg(F.count("*").alias("total"))


def search_batch(spark, d):
    return _rounded(search.search(*_page_search(spark, d)))


def _doc_words(spark, d):
    return _docs(spark, d).select("site_url", "path", F.filter(LATIN.words(F.col("content")), lambda w: ~w.isin(*LATIN_STOP)).alias("words"))


def _snippet_query(spark):
    return spark.createDataFrame([(1, "thing"), (1, "with"), (2, "avec"), (3, "nicht")], "query_id int, lemma string")


def snippet_hits(spark, d):
    return snippet.hits(_doc_words(spark, d), _snippet_query(spark))


def snippet_windows(spark, d):
    return snippet.windows(snippet_hits(spark, d))


def snippet_bucketed(spark, d):
    return snippet.bucketed(snippet_windows(spark, d), _doc_words(spark, d))


def snippet_text(spark, d):
    wanted = F.array(F.lit("thing"), F.lit("with"))
    rows = _docs(spark, d).select("site_url", "path", snippet.snippet_column(text.normalize_space(F.col("content")), wanted, LATIN, {}, set(LATIN_STOP)).alias("snippet"))
    return rows.filter("snippet <> ''")


def _three(spark, d):
    store = _store(spark, d)
    return store.table("pages"), store.postings(), store.lemmas()


def _page_digest(pages: DataFrame) -> DataFrame:
    return pages.select("site_url", "path", "code", F.md5("content").alias("digest"))


def _deleted(spark, d):
    pages, posts, lemmas = _three(spark, d)
    return index.delete_pages(pages, posts, lemmas, pages.filter(F.col("path") == ONE_DOC))


def index_delete_page(spark, d):
    return _deleted(spark, d)[2]


def index_delete_page_postings(spark, d):
    return _deleted(spark, d)[1]


def index_delete_page_pages(spark, d):
    return _page_digest(_deleted(spark, d)[0])


def _upserted(spark, d):
    """The index of ``_store`` with two pages put in anew: a part of the same index, which
    the store read before doesn't see, as it stays at the state that it began on."""
    key = (spark.sparkContext.applicationId, d, "upserted")
    if key not in _stores:
        base = _store(spark, d)
        store = Store(spark, base.folder)
        new = base.table("pages").filter(F.col("path").isin("/1", "/2")).withColumns({"content": F.concat(F.lit("zebra the "), F.coalesce("content", F.lit(""))), "ts": F.lit(None).cast("timestamp")})
        store.update(new, store.sites(), LATIN, is_html=False)
        _stores[key] = store
    return _stores[key]


def index_upsert_page(spark, d):
    return _upserted(spark, d).lemmas()


def index_upsert_page_postings(spark, d):
    return _upserted(spark, d).postings()


def index_upsert_page_pages(spark, d):
    return _page_digest(_upserted(spark, d).pages())


def frequency_increment(spark, d):
    lemmas = _store(spark, d).lemmas()
    keys = lemmas.filter("lemma = 'the'").select("site_url", "lemma").unionByName(lemmas.select("site_url").distinct().withColumn("lemma", F.lit("zebra")))
    return index.increase(lemmas, keys)


def frequency_decrement(spark, d):
    lemmas = _store(spark, d).lemmas()
    return index.decrease(lemmas, lemmas.filter("lemma < 'b'").select("site_url", "lemma"))


def page_update(spark, d):
    old = document_pages(spark, d, all_good=False)
    new = old.select("site_url", "path", F.when(F.length("path") % 2 == 0, 500).alias("code"), F.when(F.length("path") % 3 == 0, "").otherwise(F.concat("path", F.lit("!"))).alias("content"))
    return index.update_parse_info(old, new)


def _log(spark, d):
    """Fetches of documents: the home page is a site's document 0 to 49, some fail."""
    doc = F.col("doc_id")
    return load(spark, d, "documents").select(
        F.col("source").alias("site_url"), F.when(doc % 50 == 0, "/").otherwise(F.concat(F.lit("/"), doc.cast("string"))).alias("path"),
        F.when(doc % 17 == 0, 404).otherwise(200).alias("code"), F.when(doc % 401 == 400, F.concat(F.lit("timeout "), doc.cast("string"))).alias("error"), F.timestamp_seconds(doc).alias("ts"),
    )


def _begun(log):
    """Sites being indexed; one had failed before."""
    return _sites(log).withColumn("status", F.when(F.col("site_url") == "src3", "FAILED").otherwise("INDEXING")).withColumn("last_error", F.when(F.col("site_url") == "src3", "old").otherwise(""))


def site_status_fold(spark, d):
    log = _log(spark, d)
    out = status.fold_status(_begun(log), log)
    return out.select("site_url", "name", "status", F.unix_millis("status_time").alias("status_ms"), "last_error")


def site_status_stream(spark, d):
    """The same from a log that arrives in some four micro-batches, in any order."""
    log, folder = _log(spark, d), shared_folder(spark, "status")
    log.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(4))).write.partitionBy("part").parquet(f"{folder}/log")
    files = len(spark.read.parquet(f"{folder}/log").inputFiles())
    out = follow(_begun(log), f"{folder}/log/*", folder, files_at_once=-(-files // 4))
    return out.select("site_url", "name", "status", F.unix_millis("status_time").alias("status_ms"), "last_error")


def site_status_cancelled(spark, d):
    """All sites after a stop."""
    log = _log(spark, d)
    out = status.fold_status(_sites(log), log, cancelled=True)
    return out.select("site_url", "status", "last_error")


def home_page_accessible(spark, d):
    return status.home_accessible(_log(spark, d))


def index_finished_check(spark, d):
    return status.finished(_sites(_docs(spark, d)))


def any_site_not_indexed(spark, d):
    return search.sites_not_indexed(_sites(_docs(spark, d)))


def site_status_update(spark, d):
    sites = _sites(_docs(spark, d)).withColumn("last_error", F.lit("old"))
    changes = sites.filter(F.length("site_url") == 4).select("site_url", F.lit("FAILED").alias("status"), F.timestamp_millis(F.lit(5)).alias("status_time"), F.when(F.col("site_url") == "src1", "").otherwise("new").alias("error"))
    out = status.update_status(sites, changes)
    return out.select("site_url", "status", F.unix_millis("status_time").alias("status_ms"), "last_error")


def _corpus(spark, d):
    """(sites, fetches) of `pages`.  The table holds no home pages, so every page also
    stands at its site's root."""
    fetches = _fetches(spark, d)
    at_root = fetches.withColumn("page_url", urls.origin(F.col("page_url")))
    sites = at_root.select(F.col("page_url").alias("site_url")).filter("site_url <> ''").distinct()
    return sites, fetches.unionByName(at_root)


def crawl_frontier_step(spark, d):
    """What all home pages lead to."""
    sites, fetches = _corpus(spark, d)
    start = sites.withColumn("page_url", F.col("site_url"))
    return crawl.frontier_step(start, start, crawl.followed(fetches))


def crawl_closure(spark, d):
    """How many pages of each depth a crawl of all sites reaches."""
    return crawl.crawl(*_corpus(spark, d)).groupBy("site_url", "depth").agg(F.count("*").alias("n_pages"), F.max(F.length("page_url")).alias("longest"))


def crawl_depth_zero(spark, d):
    """The home pages alone, of all sites of `pages`."""
    fetches = _fetches(spark, d)
    sites = fetches.select(urls.origin(F.col("page_url")).alias("site_url")).filter("site_url <> ''").distinct()
    return crawl.crawl(sites, fetches, max_depth=0)


def crawl_pages(spark, d):
    """All sites of `pages` over its fetches."""
    return crawl.crawl(*_corpus(spark, d))


def search_response_json(spark, d):
    """The first result page of each query as the JSON of a response."""
    top = search.result_page(search.search(*_doc_search(spark, d)), 0, LIMIT)
    relevance = _to_places(_to_places(F.col("relevance").cast("double"), 6), 4)
    rows = top.groupBy("query_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("place", "site_url", "path", relevance.alias("relevance")))).alias("data"))
    asked = spark.createDataFrame(QUERY_ROWS, "query_id int, query string").join(rows, "query_id", "left")

    @F.pandas_udf("string")
    def response(queries: pd.Series, totals: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for query, total, data in zip(queries, totals, found, strict=True):
            none = data is None
            rows = [] if none else [{"site": r["site_url"], "uri": r["path"], "relevance": r["relevance"]} for r in data]
            out.append(to_json({"result": True, "error": NOTHING_FOUND + query if none else None, "count": 0 if none else int(total), "data": rows}))
        return pd.Series(out, dtype=object)

    return asked.select("query_id", response("query", "total", "data").alias("response"))


QUERIES = {
    f.__name__: f
    for f in (
        url_normalize, url_relative_path, url_is_file_link, url_page_in_site, site_of_page, page_links, page_good_links, page_link_counts, acceptable_content,
        page_title, page_clean_text_len, fold_yo, tokenize_documents, token_stopword_filter, double_letter_strip, term_frequency, page_term_frequency,
        term_frequency_good_pages, fetched_pages, document_frequency, dictionary_frequency, lemma_lookup, postings_by_lemma, postings_by_page, posting_by_lemma_page, page_lookup, page_lookup_url, page_constructor,
        pages_per_site, responsive_pages_per_site, index_counts, lemmas_per_site, stats_total, stats_detailed, lemma_frequency_limit, usable_query_lemmas,
        rarest_query_lemma, search_abs_relevance, search_ranked_all_sites, search_ranked_one_site, search_page2, search_total_count, search_batch,
        snippet_hits, snippet_windows, snippet_bucketed, snippet_text, index_delete_page, index_delete_page_postings, index_delete_page_pages, index_upsert_page, index_upsert_page_postings, index_upsert_page_pages, frequency_increment, frequency_decrement,
        page_update, site_status_fold, site_status_stream, site_status_cancelled, home_page_accessible, index_finished_check, any_site_not_indexed, site_status_update, crawl_frontier_step, crawl_closure, crawl_depth_zero, crawl_pages, search_response_json,
    )
} | catalogue_text.QUERIES


# SQL side

_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_RELATIVE = f"CASE WHEN lower(rtrim_one) = lower({_ORIGIN}) THEN '/' ELSE substr(url, length({_ORIGIN}) + 1) END"
_SLASHLESS = "CASE WHEN url LIKE '%/' THEN left(url, length(url) - 1) ELSE url END"
_PAGE_ROWS = f"""page_rows AS (
  SELECT page_id, url, html, site_url, CASE WHEN p <> '/' AND p LIKE '%/' THEN left(p, length(p) - 1) ELSE p END AS path
  FROM (SELECT page_id, url, html, {_ORIGIN} AS site_url, {_RELATIVE} AS p FROM (SELECT *, {_SLASHLESS} AS rtrim_one FROM pages))
), site_pages AS (
  SELECT * FROM page_rows QUALIFY row_number() OVER (PARTITION BY site_url, path ORDER BY page_id) = 1
)"""


def _plain(expr: str) -> str:
    """Entities that the pages have (some are cut off in one), and white space."""
    for entity, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        expr = f"replace({expr}, '{entity}', '{sign}')"
    return f"trim(regexp_replace(regexp_replace({expr}, '&amp;?', '&', 'g'), '[ \\t\\n]+', ' ', 'g'))"


def _clean(html: str) -> str:
    """The text of pages such as those of the table: links and bold print don't part
    words, other tags do, and a page may end inside a tag."""
    for pattern, instead in (("(?s)<!--.*?-->", ""), ("(?is)<(script|style)[ >].*?</(script|style)>", " "), ("</?[ab]( [^>]*)?>", ""), ("<[a-z/!][^>]*>", " "), ("<[a-zA-Z/!][^>]*$", "")):
        html = f"regexp_replace({html}, '{pattern}', '{instead}', 'gi')"
    return _plain(html)


_STOPS = ", ".join(f"'{w}'" for w in LATIN_STOP)
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{Ll}}]{{2,}}')"
_DOC_PAGES = "doc_pages AS (SELECT source AS site_url, '/' || doc_id AS path, doc_id, text FROM documents)"
_DOC_POSTS = f"""{_DOC_PAGES}, posts AS (
  SELECT site_url, path, lemma, CAST(count(*) AS FLOAT) AS rank
  FROM (SELECT site_url, path, unnest({_WORDS.format('text')}) AS lemma FROM doc_pages) WHERE lemma NOT IN ({_STOPS}) GROUP BY ALL
), lemmas AS (
  SELECT site_url, lemma, CAST(count(*) AS INT) AS frequency FROM posts GROUP BY ALL
)"""
_PAGE_POSTS = f"""{_PAGE_ROWS}, posts AS (
  SELECT site_url, path, lemma, CAST(count(*) AS FLOAT) AS rank
  FROM (SELECT site_url, path, unnest({_WORDS.format("replace(" + _clean("html") + ", 'ё', 'е')")}) AS lemma FROM site_pages) WHERE lemma NOT IN ({_STOPS}) GROUP BY ALL
), lemmas AS (
  SELECT site_url, lemma, CAST(count(*) AS INT) AS frequency FROM posts GROUP BY ALL
)"""
_ASKED = "asked(query_id, lemma) AS (VALUES " + ", ".join(f"({n}, '{w}')" for n, q in QUERY_ROWS for w in q.split()) + ")"


def _search(posts: str, pages: str) -> str:
    return f"""WITH {posts}, {_ASKED}, limits AS (
  SELECT site_url, count(*) AS good_pages, CAST(floor(count(*) * 0.9) AS INT) AS frequency_limit FROM {pages} GROUP BY site_url
), usable AS (
  SELECT query_id, site_url, lemma, frequency FROM lemmas JOIN asked USING (lemma) JOIN limits USING (site_url) WHERE frequency <= frequency_limit
), needed AS (
  SELECT query_id, site_url, count(*) AS needed FROM usable GROUP BY ALL
), absolute AS (
  SELECT query_id, site_url, path, CAST(sum(rank) AS FLOAT) AS abs_relevance FROM usable JOIN posts USING (site_url, lemma) JOIN needed USING (query_id, site_url)
  GROUP BY query_id, site_url, path, needed HAVING count(*) = needed
), ranked AS (
  SELECT query_id, site_url, path, abs_relevance, round(CAST(CAST(abs_relevance / max(abs_relevance) OVER (PARTITION BY query_id) AS FLOAT) AS DOUBLE), 6) AS relevance,
    count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY abs_relevance DESC, site_url, path) AS place
  FROM absolute
)"""


_PAGE_SEARCH, _DOC_SEARCH = _search(_PAGE_POSTS, "site_pages"), _search(_DOC_POSTS, "doc_pages")
_RANKED = "SELECT query_id, site_url, path, abs_relevance, relevance, total FROM ranked"
_SITES = "sites AS (SELECT DISTINCT source AS site_url, upper(source) AS name, CASE WHEN length(source) % 2 = 0 THEN 'INDEXED' ELSE 'INDEXING' END AS status, length(source) * 1000 AS status_ms FROM documents)"
_DOC_WORDS = f"{_DOC_PAGES}, doc_words AS (SELECT site_url, path, list_filter({_WORDS.format('text')}, lambda w: w NOT IN ({_STOPS})) AS words FROM doc_pages)"
_HITS = f"""{_DOC_WORDS}, wanted(query_id, word) AS (VALUES (1, 'thing'), (1, 'with'), (2, 'avec'), (3, 'nicht')), hits AS (
  SELECT query_id, site_url, path, CAST(ord AS INT) AS ord, word FROM (SELECT site_url, path, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS ord FROM doc_words) JOIN wanted USING (word)
)"""
_WINDOWS = f"""{_HITS}, marked AS (
  SELECT *, CASE WHEN ord - lag(ord) OVER w > 5 OR lag(ord) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM hits WINDOW w AS (PARTITION BY query_id, site_url, path ORDER BY ord)
), islands AS (
  SELECT query_id, site_url, path, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS hits
  FROM (SELECT *, sum(new) OVER (PARTITION BY query_id, site_url, path ORDER BY ord) AS island FROM marked) GROUP BY query_id, site_url, path, island
)"""
_ARRAY = "[{0}][page_id % {1} + 1]"
_HREFS = '<a href="([^"]*)">'
_LINKS = f"""hrefs AS (
  SELECT url, unnest(list_distinct(regexp_extract_all(html, '{_HREFS}', 1))) AS raw FROM {{0}}
), decoded AS (
  SELECT url, trim({{1}}) AS href, regexp_replace(url, '[?#].*$', '') AS page, {_ORIGIN} AS origin FROM hrefs
), resolved AS (
  SELECT url, CASE
    WHEN regexp_matches(href, '(?i)^https?://') THEN href
    WHEN href LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || href
    WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN ''
    WHEN href LIKE '/%' THEN origin || href
    WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href
    WHEN href LIKE '?%' THEN page || href
    WHEN href = '' THEN regexp_replace(url, '#.*$', '')
    ELSE origin || CASE WHEN page = origin THEN '/' ELSE regexp_replace(substr(page, length(origin) + 1), '[^/]*$', '') END || href END AS link
  FROM decoded
), links AS (
  SELECT DISTINCT url AS page_url, link FROM resolved WHERE link <> ''
)"""


_PAGE_LINKS = _LINKS.format("pages", "replace(raw, '&amp;', '&')")
_ROOT_LINKS = "at_root AS (SELECT " + _ORIGIN + " AS url, html FROM pages), " + _LINKS.format("at_root", "replace(raw, '&amp;', '&')")
_FILE = "(" + " OR ".join(f"contains(lower({{0}}), '{x}')" for x in urls.FILE_ENDINGS) + ")"
_CUT = "CASE WHEN link LIKE '%/' THEN left(link, length(link) - 1) ELSE link END"
# a followed link is longer than its page's url, so the walk ends; its depth is the least of all ways
_WALKED = "WITH RECURSIVE corpus AS (SELECT url, html FROM pages UNION ALL SELECT " + _ORIGIN + " AS url, html FROM pages), " + _LINKS.format("corpus", "replace(raw, '&amp;', '&')") + f""", cut AS (
  SELECT lower(CASE WHEN page_url LIKE '%/' THEN left(page_url, length(page_url) - 1) ELSE page_url END) AS key, link, {_CUT} AS short FROM links
), edges AS (
  SELECT DISTINCT key, link, lower(short) AS link_key FROM cut WHERE starts_with(lower(short), key) AND lower(short) <> key AND NOT contains(link, '#') AND NOT {_FILE.format('short')}
), sites AS (SELECT DISTINCT {_ORIGIN} AS site_url FROM pages WHERE {_ORIGIN} <> ''), walk(site_url, key, depth) AS (
  SELECT site_url, lower(site_url), 0 FROM sites UNION SELECT site_url, link_key, depth + 1 FROM walk JOIN edges USING (key)
), firsts AS (SELECT site_url, key, min(depth) AS depth FROM walk GROUP BY site_url, key), reached AS (
  SELECT site_url, site_url AS page_url, 0 AS depth FROM sites UNION ALL
  SELECT f.site_url, min(e.link), f.depth FROM firsts f JOIN firsts b ON b.site_url = f.site_url AND b.depth = f.depth - 1 JOIN edges e ON e.key = b.key AND e.link_key = f.key GROUP BY f.site_url, f.key, f.depth
)"""
_DOUBLED = "|".join(f"{c}{c}+" for c in RUSSIAN_DOUBLED)
_LOG = """log AS (
  SELECT source AS site_url, CASE WHEN doc_id % 50 = 0 THEN '/' ELSE '/' || doc_id END AS path, CASE WHEN doc_id % 17 = 0 THEN 404 ELSE 200 END AS code,
    CASE WHEN doc_id % 401 = 400 THEN 'timeout ' || doc_id END AS error, doc_id AS s FROM documents
)"""

_UPSERTED_POSTS = _DOC_POSTS.replace("doc_id, text FROM", "doc_id, CASE WHEN doc_id IN (1, 2) THEN 'zebra the ' || coalesce(text, '') ELSE text END AS text FROM", 1)

SQL = {
    "url_normalize": f"SELECT page_id, {_SLASHLESS} AS url, {_ORIGIN} AS origin, {_ORIGIN} || {_RELATIVE} AS again FROM (SELECT *, {_SLASHLESS} AS rtrim_one FROM pages)",
    "url_relative_path": f"WITH {_PAGE_ROWS} SELECT page_id, site_url, path, path = '/' AS is_home FROM page_rows",
    "url_is_file_link": f"SELECT page_id, {_FILE.format('u')} AS is_file FROM (SELECT page_id, url || " + _ARRAY.format("'', '.PDF', '/a.docx?x', '.png', '.html'", 5) + " AS u FROM pages)",
    "url_page_in_site": "SELECT page_id, contains(lower(url), lower(CASE WHEN site LIKE '%/' THEN site ELSE site || '/' END)) AS in_site, lower(site) = lower(url) AS same FROM (SELECT page_id, url, " + _ARRAY.format("'https://www.ththon.example.org', 'http://blog.tionsh.example.com/', 'example.com', 'EXAMPLE.ORG/en'", 4) + " AS site FROM pages)",
    "site_of_page": f"WITH {_PAGE_ROWS}, sites AS (SELECT DISTINCT site_url FROM page_rows WHERE length(site_url) % 2 = 0) SELECT url AS page_url, arg_max(s.site_url, (length(s.site_url), s.site_url)) AS site_url FROM pages LEFT JOIN sites s ON contains(lower(url), lower(s.site_url) || '/') GROUP BY url",
    "page_links": f"WITH {_PAGE_LINKS} SELECT page_url, link FROM links",
    "page_good_links": f"WITH {_ROOT_LINKS} SELECT page_url, link FROM links WHERE starts_with(lower({_CUT}), lower(page_url)) AND lower({_CUT}) <> lower(page_url) AND NOT contains(link, '#') AND NOT {_FILE.format(_CUT)}",
    "page_link_counts": f"WITH {_PAGE_LINKS} SELECT page_url, count(*) AS n_links FROM links GROUP BY page_url",
    "acceptable_content": "SELECT page_id, page_id % 5 IN (0, 1, 3) AS has_links FROM pages",
    "page_title": "SELECT page_id, " + _plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS title FROM pages",
    "page_clean_text_len": f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, replace({_clean('html')}, 'ё', 'е') AS t FROM pages)",
    "fold_yo": "SELECT doc_id, md5(translate(text, 'eE', 'еЁ')) AS digest FROM documents",
    "fetched_pages": "SELECT source AS site_url, '/' || doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN 404 ELSE 200 END AS code FROM documents WHERE doc_id % 5 <> 0",
    "index_counts": f"WITH {_PAGE_ROWS} SELECT site_url, count(*) AS pages, count(*) AS good_pages FROM site_pages GROUP BY site_url",
    "site_status_cancelled": f"SELECT DISTINCT source AS site_url, 'FAILED' AS status, '{status.STOPPED_BY_USER}' AS last_error FROM documents",
    "crawl_depth_zero": f"SELECT DISTINCT {_ORIGIN} AS site_url, {_ORIGIN} AS page_url, 0 AS depth FROM pages WHERE {_ORIGIN} <> ''",
    "tokenize_documents": f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word",
    "token_stopword_filter": f"SELECT site_url, lemma, count(*) AS n FROM (SELECT source AS site_url, unnest({_WORDS.format('text')}) AS lemma FROM documents) WHERE lemma NOT IN ({_STOPS}) GROUP BY ALL",
    "double_letter_strip": f"""WITH letters AS (
  SELECT doc_id, regexp_replace(translate(lower(coalesce(text, '')), '{_LATIN_LETTERS}', '{_CYRILLIC_LETTERS}'), '[^а-я\\p{{Z}}]', ' ', 'g') AS t FROM documents
), words AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(t, '(?:{_DOUBLED})\\p{{Z}}', ' ', 'g'), '[а-я]{{2,}}') AS w FROM letters
) SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM words""",
    "term_frequency": f"WITH {_DOC_POSTS} SELECT site_url, path, lemma, rank FROM posts",
    "page_term_frequency": f"WITH {_PAGE_POSTS} SELECT site_url, path, lemma, rank FROM posts",
    "term_frequency_good_pages": f"WITH {_DOC_POSTS} SELECT site_url, path, count(*) AS lemmas, CAST(sum(rank) AS BIGINT) AS words FROM posts WHERE CAST(substr(path, 2) AS BIGINT) % 17 <> 0 GROUP BY ALL",
    "document_frequency": f"WITH {_DOC_POSTS} SELECT site_url, lemma, frequency FROM lemmas",
    "lemma_lookup": f"WITH {_DOC_POSTS} SELECT site_url, lemma, frequency FROM lemmas WHERE site_url = '{ONE_SITE}' AND lemma = '{ONE_LEMMA}'",
    "postings_by_lemma": f"WITH {_DOC_POSTS} SELECT site_url, path, lemma, rank FROM posts WHERE site_url = '{ONE_SITE}' AND lemma = '{ONE_LEMMA}'",
    "postings_by_page": f"WITH {_DOC_POSTS} SELECT site_url, path, lemma, rank FROM posts WHERE path = '{ONE_DOC}'",
    "posting_by_lemma_page": f"WITH {_DOC_POSTS} SELECT site_url, path, lemma, rank FROM posts WHERE path = '{ONE_DOC}' AND lemma = '{ONE_LEMMA}'",
    "dictionary_frequency": f"""WITH {_DOC_PAGES}, words AS (
  SELECT site_url, path, word FROM (SELECT site_url, path, unnest({_WORDS.format('text')}) AS word FROM doc_pages) WHERE NOT (length(word) = 4 AND word LIKE '%n')
), ranks AS (
  SELECT site_url, path, CASE WHEN length(word) > 3 AND word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS lemma, count(*) AS n FROM words GROUP BY ALL
) SELECT site_url, lemma, CAST(sum(n) AS BIGINT) AS words, count(*) AS pages FROM ranks GROUP BY ALL""",
    "page_lookup": f"WITH {_PAGE_ROWS} SELECT site_url, path, 200 AS code, md5(html) AS digest FROM site_pages JOIN (SELECT site_url, path FROM page_rows WHERE page_id = 0) USING (site_url, path)",
    "page_lookup_url": f"WITH {_PAGE_ROWS} SELECT site_url, path, 200 AS code, md5(html) AS digest FROM site_pages JOIN (SELECT site_url, path FROM page_rows WHERE page_id = 0) USING (site_url, path)",
    "page_constructor": f"WITH {_PAGE_ROWS} SELECT site_url, CASE WHEN path = '/' THEN '/' ELSE substr(url, length(site_url) + 1) END AS path, CAST(NULL AS INT) AS code, '' AS content, path AS saved_path FROM page_rows",
    "pages_per_site": "SELECT source AS site_url, count(*) AS pages FROM documents GROUP BY source",
    "responsive_pages_per_site": "SELECT source AS site_url, count(*) FILTER (doc_id % 17 <> 0) AS pages FROM documents GROUP BY source",
    "lemmas_per_site": f"WITH {_DOC_POSTS} SELECT site_url, count(*) AS lemmas FROM lemmas GROUP BY site_url",
    "stats_total": f"WITH {_DOC_POSTS}, {_SITES} SELECT (SELECT count(*) FROM sites) AS sites, (SELECT count(*) FROM doc_pages) AS pages, (SELECT count(*) FROM lemmas) AS lemmas, (SELECT bool_or(status = 'INDEXING') FROM sites) AS indexing",
    "stats_detailed": f"WITH {_DOC_POSTS}, {_SITES} SELECT site_url AS url, name, status, CAST(status_ms AS BIGINT) AS status_time, '' AS error, (SELECT count(*) FROM doc_pages p WHERE p.site_url = s.site_url) AS pages, (SELECT count(*) FROM lemmas l WHERE l.site_url = s.site_url) AS lemmas FROM sites s",
    "lemma_frequency_limit": f"WITH {_PAGE_ROWS} SELECT site_url, count(*) AS good_pages, CAST(floor(count(*) * 0.9) AS INT) AS frequency_limit FROM site_pages GROUP BY site_url",
    "usable_query_lemmas": f"{_PAGE_SEARCH} SELECT query_id, site_url, lemma, frequency FROM usable",
    "rarest_query_lemma": f"{_PAGE_SEARCH} SELECT query_id, site_url, lemma, frequency FROM usable QUALIFY row_number() OVER (PARTITION BY query_id, site_url ORDER BY frequency, lemma) = 1",
    "search_abs_relevance": f"{_PAGE_SEARCH} SELECT query_id, site_url, path, abs_relevance FROM absolute",
    "search_ranked_all_sites": f"{_DOC_SEARCH} {_RANKED} WHERE query_id = 1",
    "search_ranked_one_site": _search(_DOC_POSTS.replace("FROM documents)", f"FROM documents WHERE source = '{ONE_SITE}')", 1), "doc_pages") + f" {_RANKED} WHERE query_id = 1",
    "search_page2": f"{_DOC_SEARCH} SELECT query_id, CAST(place AS INT) AS place, site_url, path FROM ranked WHERE place <= {2 * LIMIT} AND (total <= {LIMIT} OR place > {LIMIT})",
    "search_total_count": f"{_DOC_SEARCH} SELECT query_id, count(*) AS total FROM ranked GROUP BY query_id",
    "search_batch": f"{_PAGE_SEARCH} {_RANKED}",
    "snippet_hits": f"WITH {_HITS} SELECT query_id, site_url, path, ord, word FROM hits",
    "snippet_windows": f"WITH {_WINDOWS} SELECT * FROM islands",
    "snippet_bucketed": f"WITH {_WINDOWS} SELECT query_id, site_url, path, hits, string_agg(array_to_string(words[greatest(first_ord - 2, 0) + 1 : last_ord + 3], ' ') || '... ', '' ORDER BY first_ord) AS text FROM islands JOIN doc_words USING (site_url, path) GROUP BY ALL",
    "index_delete_page": f"WITH {_DOC_POSTS} SELECT site_url, lemma, CAST(count(*) AS INT) AS frequency FROM posts WHERE path <> '{ONE_DOC}' GROUP BY ALL",
    "index_delete_page_postings": f"WITH {_DOC_POSTS} SELECT site_url, path, lemma, rank FROM posts WHERE path <> '{ONE_DOC}'",
    "index_delete_page_pages": f"WITH {_DOC_PAGES} SELECT site_url, path, 200 AS code, md5(text) AS digest FROM doc_pages WHERE path <> '{ONE_DOC}'",
    "index_upsert_page": f"WITH {_UPSERTED_POSTS} SELECT site_url, lemma, frequency FROM lemmas",
    "index_upsert_page_postings": f"WITH {_UPSERTED_POSTS} SELECT site_url, path, lemma, rank FROM posts",
    "index_upsert_page_pages": f"WITH {_UPSERTED_POSTS} SELECT site_url, path, 200 AS code, md5(text) AS digest FROM doc_pages",
    "frequency_increment": f"WITH {_DOC_POSTS} SELECT site_url, lemma, CAST(sum(n) AS INT) AS frequency FROM (SELECT site_url, lemma, frequency AS n FROM lemmas UNION ALL SELECT site_url, lemma, 1 FROM lemmas WHERE lemma = 'the' UNION ALL SELECT DISTINCT site_url, 'zebra', 1 FROM lemmas) GROUP BY ALL",
    "frequency_decrement": f"WITH {_DOC_POSTS} SELECT site_url, lemma, CASE WHEN lemma < 'b' THEN frequency - 1 ELSE frequency END AS frequency FROM lemmas WHERE lemma >= 'b' OR frequency > 1",
    "page_update": "SELECT source AS site_url, p AS path, CASE WHEN length(p) % 2 = 0 THEN 500 WHEN doc_id % 17 = 0 THEN 404 ELSE 200 END AS code, CASE WHEN length(p) % 3 = 0 THEN text ELSE p || '!' END AS content FROM (SELECT *, '/' || doc_id AS p FROM documents)",
    "site_status_fold": f"""WITH {_LOG}, facts AS (
  SELECT site_url, bool_or(error IS NOT NULL) AS bad, arg_min(error, s) FILTER (error IS NOT NULL) AS first_error, bool_or(path = '/' AND code = 200) AS home, max(s) AS last_s FROM log GROUP BY site_url
) SELECT site_url, upper(site_url) AS name, CASE WHEN site_url = 'src3' OR bad OR NOT home THEN 'FAILED' ELSE 'INDEXED' END AS status, greatest(length(site_url) * 1000, last_s * 1000) AS status_ms,
  CASE WHEN site_url = 'src3' THEN 'old' WHEN bad THEN first_error WHEN NOT home THEN '{status.HOME_NOT_ACCESSIBLE}' ELSE '' END AS last_error FROM facts""",
    "home_page_accessible": f"WITH {_LOG} SELECT site_url, bool_or(path = '/' AND code = 200) AS accessible FROM log GROUP BY site_url",
    "index_finished_check": f"WITH {_SITES} SELECT bool_and(status IN ('INDEXED', 'FAILED')) AS finished FROM sites",
    "any_site_not_indexed": f"WITH {_SITES} SELECT bool_or(status <> 'INDEXED') AS not_indexed FROM sites",
    "site_status_update": f"WITH {_SITES} SELECT site_url, CASE WHEN length(site_url) = 4 THEN 'FAILED' ELSE status END AS status, CAST(CASE WHEN length(site_url) = 4 THEN 5 ELSE status_ms END AS BIGINT) AS status_ms, CASE WHEN length(site_url) = 4 AND site_url <> 'src1' THEN 'new' ELSE 'old' END AS last_error FROM sites",
    "crawl_frontier_step": f"{_WALKED} SELECT site_url, min(link) AS page_url FROM sites JOIN edges ON key = lower(site_url) WHERE link_key <> key GROUP BY site_url, link_key",
    "crawl_closure": f"{_WALKED} SELECT site_url, depth, count(*) AS n_pages, CAST(max(length(page_url)) AS INT) AS longest FROM reached GROUP BY site_url, depth",
    "crawl_pages": f"{_WALKED} SELECT site_url, page_url, depth FROM reached",
    "search_response_json": f"""{_DOC_SEARCH}, responses AS (
  SELECT query_id, max(total) AS total, string_agg('{{"site": "' || site_url || '", "uri": "' || path || '", "relevance": ' || CAST(round(relevance, 4) AS VARCHAR) || '}}', ', ' ORDER BY place) AS data FROM ranked WHERE place <= {LIMIT} GROUP BY query_id
), named(query_id, query) AS (VALUES """ + ", ".join(f"({n}, '{q}')" for n, q in QUERY_ROWS) + f""")
SELECT query_id, CASE WHEN total IS NULL THEN '{{"result": true, "error": "{NOTHING_FOUND}' || query || '", "count": 0, "data": []}}'
  ELSE '{{"result": true, "count": ' || total || ', "data": [' || data || ']}}' END AS response FROM named LEFT JOIN responses USING (query_id)""",
} | catalogue_text.SQL
SQL["site_status_stream"] = SQL["site_status_fold"]
