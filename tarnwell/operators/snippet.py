"""Snippets: the words around query words on a page.

Hits at most five words apart are one window, from two words before the first
hit to two after the last.  Windows with more hits come first.  The windows are
a gaps-and-islands query over word places; the final string, cut to length and
with hits in bold, is made for the pages of a result only, by a pandas function.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analyzer import Analyzer

AROUND = 2
MOST = 250
DOTS = "..."


def located_words(words: DataFrame) -> DataFrame:
    """(site_url, path, ord, word) of pages with an array ``words``."""
    return words.select("site_url", "path", F.posexplode("words").alias("ord", "word"))


def hits(words: DataFrame, query: DataFrame) -> DataFrame:
    """(query_id, site_url, path, ord, word) of words that are query lemmas."""
    return located_words(words).join(query.select("query_id", F.col("lemma").alias("word")), "word").select("query_id", "site_url", "path", "ord", "word")


def windows(found: DataFrame) -> DataFrame:
    """(query_id, site_url, path, first_ord, last_ord, hits) of each island of
    hits; a page's hits are one small group."""
    page = Window.partitionBy("query_id", "site_url", "path").orderBy("ord")
    gap = F.col("ord") - F.lag("ord").over(page) > 2 * AROUND + 1
    islands = found.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(page))
    return islands.groupBy("query_id", "site_url", "path", "island").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("hits")).drop("island")


def bucketed(islands: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, site_url, path, hits, text): the windows with equally many hits,
    as words in text order, each followed by dots."""
    text = islands.join(words.select("site_url", "path", "words"), ["site_url", "path"])
    first = F.greatest(F.col("first_ord") - AROUND, F.lit(0))
    piece = F.concat(F.array_join(F.slice("words", first + 1, F.col("last_ord") + AROUND - first + 1), " "), F.lit(DOTS + " "))
    pieces = text.select("query_id", "site_url", "path", "hits", F.struct("first_ord", piece.alias("piece")).alias("p"))
    joined = pieces.groupBy("query_id", "site_url", "path", "hits").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return joined.select("query_id", "site_url", "path", "hits", F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("text"))


def _located(text: str, words: list[str]) -> list[tuple[int, str]]:
    """Where each word stands, looked for after the one before it; words that are
    not found are left out, so places count located words only."""
    low, at, out = text.lower(), 0, []
    if len(low) != len(text):  # a letter that grows in lower case: keep positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for word in words:
        found = low.find(word, at)
        if found >= 0:
            out.append((found, text[found : found + len(word)]))
            at = found + len(word)
    return out


def _cut(text: str) -> str:
    """To the last dots within the limit, or else to the last space, with dots."""
    at = text.rfind(DOTS, 0, MOST)
    if at < 0:
        at = max(0, text.rfind(" ", 0, MOST))
    text = text[: at + len(DOTS)]
    return text if text.endswith(DOTS) else text[: -len(DOTS)] + DOTS


def bold(text: str, forms: set[str]) -> str:
    """Forms in bold, the longest that fits, where no letter follows; a form at
    the end of a longer word is in bold too."""
    if not forms:
        return text
    any_form = "|".join(regex.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f)))
    return regex.sub(rf"(?<!<b>)({any_form})(?!\p{{L}})", r"<b>\1</b>", text)


def make_snippet(text: str, wanted: set[str], words: list[str], lemma: dict[str, str]) -> str:
    """The snippet of a clean text; empty where no word has a wanted lemma."""
    located = _located(text, words)
    of = [lemma.get(form.lower(), form.lower()) for _, form in located]
    low = {w.lower() for w in wanted}
    places = [k for k, own in enumerate(of) if own.lower() in low]
    islands: list[list[int]] = []
    for k in places:
        if islands and k - islands[-1][-1] <= 2 * AROUND + 1:
            islands[-1].append(k)
        else:
            islands.append([k])
    buckets: dict[int, str] = {}
    for own in islands:
        first, last = max(0, own[0] - AROUND), min(len(located) - 1, own[-1] + AROUND)
        piece = text[located[first][0] : located[last][0] + len(located[last][1])] + DOTS + " "
        buckets[len(own)] = buckets.get(len(own), "") + piece
    out = ""
    for count in sorted(buckets, reverse=True):
        out += buckets[count]
        if len(out) > MOST:
            out = _cut(out)
            break
    return bold(out, {located[k][1] for k in places})


def snippet_column(text: Column, wanted: Column, analyzer: Analyzer, lemma: dict[str, str], stops: set[str]) -> Column:
    """The snippet of each row, made one by one in Python; meant for the rows of a
    result page.  ``lemma`` and ``stops`` are what a dictionary says of the words
    on those pages."""
    cut = analyzer.words_py

    @F.pandas_udf("string")
    def snippets(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else make_snippet(t, set(w), [x for x in cut(t) if x not in stops], lemma) for t, w in zip(texts, wanted, strict=True)], dtype=object)

    return snippets(text, wanted)
