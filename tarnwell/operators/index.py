"""The inverted index: postings, lemma frequencies, and their upkeep.

Postings are the only facts; the frequency of a lemma on a site is their count.
Single-page updates are signed deltas of that count, so an updated index equals
one that is built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.analyzer import Analyzer, Dictionary, lemmas_of_words, term_counter
from ..functions.text import clean_text

PAGE_KEY = ["site_url", "path"]
LEMMA_KEY = ["site_url", "lemma"]
GOOD_CODE = 200
FEW_KEYS = 100_000


def new_pages(page_urls: DataFrame) -> DataFrame:
    """Pages to be fetched, of (page_url, site_url): the path as the url has it, no
    code, empty content.  A url of another site is an error."""
    path = urls.relative_path(F.col("page_url"), F.col("site_url"), strict=True)
    return page_urls.select("site_url", path.alias("path"), F.lit(None).cast("int").alias("code"), F.lit("").alias("content"))


def saved_pages(pages: DataFrame) -> DataFrame:
    """Pages as they are stored: paths without a trailing slash."""
    return pages.withColumn("path", urls.stored_path(F.col("path")))


def good_pages(pages: DataFrame) -> DataFrame:
    """Pages with code 200; a null code is not good."""
    return pages.filter(F.col("code").eqNullSafe(GOOD_CODE))


def fetched_pages(pages: DataFrame) -> DataFrame:
    """Pages that were fetched at all."""
    return pages.filter(F.col("code").isNotNull())


def words_of(pages: DataFrame, analyzer: Analyzer, is_html: bool = True) -> DataFrame:
    """(site_url, path, word) of each word, repeats included."""
    text = clean_text(F.col("content")) if is_html else F.col("content")
    read = pages.select(*PAGE_KEY, text.alias("text"))
    return read.select(*PAGE_KEY, F.explode(analyzer.words(F.col("text"))).alias("word"))


def postings(pages: DataFrame, analyzer: Analyzer, dictionary: Dictionary | None = None, is_html: bool = True) -> DataFrame:
    """(site_url, path, lemma, rank): how often a lemma stands on a page with code
    200.  With a dictionary that may be broadcast, as a table or compiled, words become lemmas in the
    page's row and are counted there, so the one exchange (rows of one key add up) carries a row for each
    lemma of a page.  A larger one is met by counted words, and forms of one lemma
    add up after that."""
    dictionary = dictionary or Dictionary.seed(pages.sparkSession, analyzer)
    if dictionary.small or dictionary.morphology is not None:
        terms = with_terms(good_pages(pages), analyzer, dictionary, is_html).select(*PAGE_KEY, F.explode("terms").alias("t"))
        return terms.select(*PAGE_KEY, "t.*").groupBy(*PAGE_KEY, "lemma").agg(F.sum("rank").cast("float").alias("rank"))
    words = words_of(good_pages(pages), analyzer, is_html)
    counted = words.groupBy(*PAGE_KEY, "word").agg(F.count("*").alias("n"))
    return lemmas_of_words(counted, dictionary).groupBy(*PAGE_KEY, "lemma").agg(F.sum("n").cast("float").alias("rank"))


def with_terms(pages: DataFrame, analyzer: Analyzer, dictionary: Dictionary | None = None, is_html: bool = True) -> DataFrame:
    """Adds ``terms``, an array of (lemma, rank), to pages (keys unique): what ``postings``
    says of each page, counted in the page's own row, so that nothing is shuffled.  A
    dictionary that may not be broadcast goes by ``postings``, a page's terms then meet its row."""
    dictionary = dictionary or Dictionary.seed(pages.sparkSession, analyzer)
    if dictionary.small or dictionary.morphology is not None:
        text = clean_text(F.col("content")) if is_html else F.col("content")
        words = F.when(F.col("code").eqNullSafe(GOOD_CODE), analyzer.words(text))
        return pages.withColumn("terms", term_counter(dictionary)(words))
    posts = postings(pages, analyzer, dictionary, is_html)
    terms = posts.groupBy(*PAGE_KEY).agg(F.collect_list(F.struct("lemma", "rank")).alias("terms"))
    return pages.join(terms, PAGE_KEY, "left")


def frequencies(posts: DataFrame) -> DataFrame:
    """(site_url, lemma, frequency): on how many pages of a site a lemma stands."""
    return posts.groupBy(*LEMMA_KEY).agg(F.count("*").cast("int").alias("frequency"))


def apply_deltas(lemmas: DataFrame, deltas: DataFrame) -> DataFrame:
    """Frequencies after signed changes (site_url, lemma, delta); rows that come
    to zero go."""
    old = lemmas.select(*LEMMA_KEY, F.col("frequency").alias("delta"))
    total = old.unionByName(deltas.select(*LEMMA_KEY, "delta")).groupBy(*LEMMA_KEY).agg(F.sum("delta").cast("int").alias("frequency"))
    return total.filter("frequency > 0")


def increase(lemmas: DataFrame, keys: DataFrame) -> DataFrame:
    """One more for each key, a new row with 1 where there is none."""
    return apply_deltas(lemmas, keys.select(*LEMMA_KEY, F.lit(1).alias("delta")))


def decrease(lemmas: DataFrame, keys: DataFrame) -> DataFrame:
    """One less for each key that is there; a row at 1 goes.  One pass over both."""
    old = lemmas.select(*LEMMA_KEY, F.col("frequency").alias("delta"), F.lit(True).alias("known"))
    both = old.unionByName(keys.select(*LEMMA_KEY, F.lit(-1).alias("delta"), F.lit(False).alias("known")))
    total = both.groupBy(*LEMMA_KEY).agg(F.sum("delta").cast("int").alias("frequency"), F.bool_or("known").alias("known"))
    return total.filter("known AND frequency > 0").drop("known")


def delete_pages(pages: DataFrame, posts: DataFrame, lemmas: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the pages (site_url, path) of ``keys``, which are counted;
    where they are few, they are broadcast and neither pages nor postings are shuffled."""
    keys = keys.select(*PAGE_KEY).distinct()
    if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        keys = F.broadcast(keys)
    gone = posts.join(keys, PAGE_KEY, "left_semi").groupBy(*LEMMA_KEY).agg((-F.count("*")).cast("int").alias("delta"))
    return pages.join(keys, PAGE_KEY, "left_anti"), posts.join(keys, PAGE_KEY, "left_anti"), apply_deltas(lemmas, gone)


def upsert_pages(pages: DataFrame, posts: DataFrame, lemmas: DataFrame, new: DataFrame, analyzer: Analyzer, dictionary: Dictionary | None = None, is_html: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with the pages ``new`` (keys unique) put in or replaced.
    Only the new pages are analyzed."""
    rest, rest_posts, rest_lemmas = delete_pages(pages, posts, lemmas, new)
    own = postings(new, analyzer, dictionary, is_html)
    added = own.groupBy(*LEMMA_KEY).agg(F.count("*").cast("int").alias("delta"))
    return rest.unionByName(new.select(rest.columns)), rest_posts.unionByName(own), apply_deltas(rest_lemmas, added)


def update_parse_info(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages (site_url, path, code, content) after fetch results; a null code, or a
    null or empty content, changes nothing."""
    new = new.select(*PAGE_KEY, F.col("code").alias("new_code"), F.nullif(F.col("content"), F.lit("")).alias("new_content"))
    out = old.join(new, PAGE_KEY, "left")
    return out.select(*PAGE_KEY, F.coalesce("new_code", "code").alias("code"), F.coalesce("new_content", "content").alias("content"))


# lookups

def page_by_path(pages: DataFrame, site_url: str, path: str) -> DataFrame:
    path = path if path == "/" else path.removesuffix("/")
    return pages.filter((F.col("site_url") == site_url) & (F.col("path") == path))


def page_by_url(pages: DataFrame, site_url: str, url: str) -> DataFrame:
    """No row for a url of another site."""
    wanted = urls.stored_path(urls.relative_path(F.lit(url), F.lit(site_url)))
    return pages.filter((F.col("site_url") == site_url) & (F.col("path") == wanted))


def postings_by_lemma(posts: DataFrame, site_url: str, lemma: str) -> DataFrame:
    return posts.filter((F.col("site_url") == site_url) & (F.col("lemma") == lemma))


def postings_by_page(posts: DataFrame, site_url: str, path: str) -> DataFrame:
    return posts.filter((F.col("site_url") == site_url) & (F.col("path") == path))


def posting(posts: DataFrame, site_url: str, path: str, lemma: str) -> DataFrame:
    return postings_by_page(posts, site_url, path).filter(F.col("lemma") == lemma)


def lemma_row(lemmas: DataFrame, site_url: str, lemma: str) -> DataFrame:
    return lemmas.filter((F.col("site_url") == site_url) & (F.col("lemma") == lemma))
