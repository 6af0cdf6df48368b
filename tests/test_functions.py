import pytest
from pyspark.sql import functions as F

from tarnwell.functions import text, urls
from tarnwell.functions.analyzer import LATIN, MORPH_SCHEMA, RUSSIAN, Dictionary, lemmas_of_words, query_lemmas

SITE = "https://test-site-url"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("url", "path"), [(f"{SITE}/path", "/path"), (SITE, "/"), (f"{SITE}/", "/"), (f"{SITE}/path/", "/path/"), (f"{SITE.upper()}/Path", "/Path"), ("https://other/path", None), (None, None)])
def test_relative_path(spark, url, path):
    assert value(spark, urls.relative_path(F.lit(url).cast("string"), F.lit(SITE))) == path


def test_foreign_url_is_an_error_when_strict(spark):
    with pytest.raises(Exception, match="is not a page of"):
        value(spark, urls.relative_path(F.lit("https://other/path"), F.lit(SITE), strict=True))


@pytest.mark.parametrize(("url", "out"), [(f"{SITE}/path/", f"{SITE}/path"), ("/path/", "/path"), ("/path", "/path"), ("/a//", "/a/"), (None, None)])
def test_remove_trailing_slash(spark, url, out):
    assert value(spark, urls.remove_trailing_slash(F.lit(url).cast("string"))) == out


@pytest.mark.parametrize(
    ("page", "link", "good"),
    [
        (f"{SITE}/path", f"{SITE}/path/smth", True), (f"{SITE}/path/", f"{SITE}/path/smth", True), (f"{SITE}/path", f"{SITE}/another-path/smth", False),
        (f"{SITE}/path", f"{SITE}/path", False), (f"{SITE}/path/", f"{SITE}/path", False), (f"{SITE}/path", f"{SITE}/path/", False), (f"{SITE}/path/", f"{SITE}/path/", False),
        (f"{SITE}/path", f"{SITE}/path#", False), (f"{SITE}/path", f"{SITE}/path/#", False), (f"{SITE}/path", f"{SITE}/path#smth", False), (f"{SITE}/path", f"{SITE}/path/a.PDF", False),
        (SITE, f"{SITE}.evil.com", True),
    ],
)
def test_good_link(spark, page, link, good):
    assert value(spark, urls.is_good_link(F.lit(page), F.lit(link))) is good


def test_strict_boundary(spark):
    assert value(spark, urls.is_good_link(F.lit(SITE), F.lit(f"{SITE}.evil.com"), strict_boundary=True)) is False
    assert value(spark, urls.is_good_link(F.lit(SITE), F.lit(f"{SITE}/a"), strict_boundary=True)) is True


def test_home_and_site(spark):
    assert value(spark, urls.is_home_path(F.lit("/"))) is True
    assert value(spark, urls.is_home_path(F.lit(None).cast("string"))) is False
    assert value(spark, urls.page_in_site(F.lit(SITE), F.lit(f"{SITE}/path"))) is True
    assert value(spark, urls.page_in_site(F.lit(SITE), F.lit(f"{SITE}-not/path"))) is False
    assert value(spark, urls.page_in_site(F.lit(SITE), F.lit(SITE))) is False


@pytest.mark.parametrize(("href", "out"), [("/x", f"{SITE}/x"), ("y", f"{SITE}/a/y"), ("//h/z", "https://h/z"), ("http://q/", "http://q/"), ("#t", f"{SITE}/a/b?c#t"), ("?d", f"{SITE}/a/b?d"), ("mailto:x@y", ""), ("javascript:void(0)", "")])
def test_resolve(spark, href, out):
    assert value(spark, urls.resolve_href(F.lit(f"{SITE}/a/b?c"), F.lit(href))) == out


def test_html(spark):
    page = '<html><title> A &amp; B </title><script>"</p>"</script><style>p{}</style><!-- no <b> --><p>one<p>two &copy; <b>three &amp;lt;</html>'
    assert value(spark, text.html_title(F.lit(page))) == "A & B"
    assert value(spark, text.html_text(F.lit(page))) == "A & B one two © three &lt;"
    assert value(spark, text.html_title(F.lit("<p>none"))) == ""


def test_russian_words(spark):
    words = lambda t: value(spark, RUSSIAN.words(text.fold_yo(F.lit(t))))
    assert words("класс и грамм, масс") == ["кла", "гра", "масс"]
    assert words("ещё Ёж памc") == ["еще", "пам"]
    for t in ("класс и грамм, масс", "ещё Ёж памc", "Да - нет, класс! грамм\u00a0и металл", "лл ссс аа"):
        assert RUSSIAN.words_py(t.replace("ё", "е")) == words(t)


def test_latin_words(spark):
    t = "The Ägypten d'être x 42 señor"
    assert value(spark, LATIN.words(F.lit(t))) == LATIN.words_py(t) == ["the", "ägypten", "être", "señor"]


def test_query_lemmas(spark):
    asked = spark.createDataFrame([(1, "Старые мельницы или мельница"), (2, "  "), (3, "и")], "query_id int, query string")
    got = sorted(tuple(r) for r in query_lemmas(asked, RUSSIAN).collect())
    assert got == [(1, "мельница"), (1, "старый")]


def test_large_dictionary_equals_small(spark):
    morph = spark.createDataFrame([("mice", "mouse", "С", 0), ("mice", "mica", "С", 1), ("ran", "run", "Г", 0), ("of", "of", "С", 0), ("of", "of", "ПРЕДЛ", 1), ("odd", "never", "С", 1), ("same", "same", "С", 0), ("null", None, None, 0)], MORPH_SCHEMA)
    words = spark.createDataFrame([(w,) for w in "mice mice ran of odd same null other of mice".split()], "word string")
    small, large = Dictionary.of(morph), Dictionary.of(morph, most=3)
    assert small.small and not large.small
    got = [sorted(tuple(r) for r in lemmas_of_words(words, d).select("word", "lemma").collect()) for d in (small, large)]
    assert got[0] == got[1] == sorted([("mice", "mouse")] * 3 + [("ran", "run"), ("odd", "odd"), ("same", "same"), ("null", "null"), ("other", "other")])
    assert small.readings(words) == ({"mice": "mouse", "ran": "run", "of": "of", "same": "same"}, {"of"})


def test_large_dictionary_gives_the_same_postings(spark):
    from tarnwell.operators import index

    morph = spark.createDataFrame([("mice", "mouse", "С", 0), ("and", "and", "СОЮЗ", 0)], MORPH_SCHEMA)
    pages = spark.createDataFrame([("s", "/a", 200, "mice and mouse mice"), ("s", "/b", 200, "mouse")], "site_url string, path string, code int, content string")
    got = [sorted(tuple(r) for r in index.postings(pages, LATIN, Dictionary.of(morph, most=n)).collect()) for n in (9, 1)]
    assert got[0] == got[1] == [("s", "/a", "mouse", 3.0), ("s", "/b", "mouse", 1.0)]
