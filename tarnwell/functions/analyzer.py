"""Word analysis: which words a text has and what their lemmas are.

An analyzer profile is the pluggable point: a column expression that cuts the
words, and a morphology table (form, lemma, pos, ord) that gives the lemma of a
form (that of ord 0) and the forms whose part of speech is not indexed.  A form
that is not in the table is its own lemma.  The table is a seed in the profile or
one of any size, given as a `Dictionary`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.automaton import TooLarge
from .html import BATCH_BYTES
from .morphology import Morphology, compiled, reader

MORPH_SCHEMA = "form string, lemma string, pos string, ord int"
#: Interjection, preposition, conjunction, pronoun.
STOP_POS = ["МЕЖД", "ПРЕДЛ", "СОЮЗ", "МС"]
#: Letters of Russian words (ё is folded before), and those that cut
#: a word short when they are doubled at its end.
RUSSIAN_LETTERS = "а-я"
RUSSIAN_DOUBLED = "бвгджзклмнпрстхцчшщъыь"

#: Steps from a text in lower case to its words: patterns that become a space, then
#: the pattern of a word.  Java and Python read them alike.
RUSSIAN_STEPS = [rf"[^{RUSSIAN_LETTERS}\p{{Z}}]", rf"([{RUSSIAN_DOUBLED}])\1+\p{{Z}}"], rf"[{RUSSIAN_LETTERS}]{{2,}}"
LATIN_STEPS = [], r"\p{Ll}{2,}"
BROADCAST_FORMS = 1_000_000


def _words(steps: tuple[list[str], str]) -> Callable[[Column], Column]:
    def cut(text: Column) -> Column:
        text = F.lower(text)
        for pattern in steps[0]:
            text = F.regexp_replace(text, pattern, " ")
        return F.regexp_extract_all(text, F.lit(steps[1]), F.lit(0))

    return cut


def _words_py(steps: tuple[list[str], str]) -> Callable[[str], list[str]]:
    def cut(text: str) -> list[str]:
        text = text.lower()
        for pattern in steps[0]:
            text = regex.sub(pattern, " ", text)
        return regex.findall(steps[1], text)

    return cut


@dataclass(frozen=True)
class Analyzer:
    """words: all words of a text in order, before stop forms are dropped.
    words_py: the same for one string, for the snippets of a result page."""

    name: str
    words: Callable[[Column], Column]
    words_py: Callable[[str], list[str]]
    morph: tuple[tuple[str, str, str, int], ...] = ()

    def morph_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.morph), MORPH_SCHEMA)


@dataclass(frozen=True)
class Dictionary:
    """forms: (form, known, stop), one row a form: its lemma, null if it has none,
    and whether any reading is of a stop class.  small: whether the table was
    counted and may be broadcast.  morphology: the same as an automaton, with or
    without a guesser for other forms; words are then read where they stand."""

    forms: DataFrame
    small: bool
    morphology: Morphology | None = None

    @staticmethod
    def of(morph: DataFrame, most: int = BROADCAST_FORMS) -> Dictionary:
        """The dictionary of a morphology table, counted once."""
        forms = _forms(morph)
        return Dictionary(forms, forms.limit(most + 1).count() <= most)

    def compile(self, guess: bool = False) -> Dictionary:
        """The same as an automaton, where that may be broadcast; beyond that forms are
        met by a join and there is no guessing."""
        try:
            return replace(self, morphology=compiled(self.forms, guess))
        except TooLarge:
            return self

    @staticmethod
    def seed(spark: SparkSession, analyzer: Analyzer) -> Dictionary:
        """That of a profile's own few forms."""
        return Dictionary(_forms(analyzer.morph_table(spark)), len(analyzer.morph) <= BROADCAST_FORMS)

    def readings(self, words: DataFrame) -> tuple[dict[str, str], set[str]]:
        """Lemmas and stop forms among the rows (word) of some pages."""
        if self.morphology is not None:
            rows = words.distinct().select("word", reader(self.morphology, words.sparkSession)(F.col("word")).alias("r")).select("word", "r.*").filter("word IS NOT NULL").collect()
            return {r.word: r.lemma for r in rows}, {r.word for r in rows if r.stop}
        found = words.distinct().join(self.forms, F.col("word") == F.col("form")).select("form", "known", "stop").collect()
        return {r.form: r.known for r in found if r.known is not None}, {r.form for r in found if r.stop}


#: A seed dictionary, enough for the tests; a full one is a table
#: of the same four columns.
RUSSIAN_SEED = (
    ("мельница", "мельница", "С", 0), ("мельницы", "мельница", "С", 0), ("мельницу", "мельница", "С", 0), ("мельниц", "мельница", "С", 0),
    ("старый", "старый", "П", 0), ("старая", "старый", "П", 0), ("старые", "старый", "П", 0),
    ("или", "или", "СОЮЗ", 0), ("и", "и", "СОЮЗ", 0), ("но", "но", "СОЮЗ", 0), ("на", "на", "ПРЕДЛ", 0), ("до", "до", "ПРЕДЛ", 0),
    ("он", "он", "МС", 0), ("она", "она", "МС", 0), ("ах", "ах", "МЕЖД", 0),
)
#: Conjunctions of the four languages of the Latin profile.
LATIN_STOP = ("and", "und", "et", "por")

RUSSIAN = Analyzer("ru", _words(RUSSIAN_STEPS), _words_py(RUSSIAN_STEPS), RUSSIAN_SEED)
LATIN = Analyzer("latin", _words(LATIN_STEPS), _words_py(LATIN_STEPS), tuple((w, w, "СОЮЗ", 0) for w in LATIN_STOP))


def _forms(morph: DataFrame) -> DataFrame:
    stop = F.lit(False)
    for pos in STOP_POS:
        stop = stop | F.coalesce(F.col("pos").contains(pos), F.lit(False))
    return morph.groupBy("form").agg(F.min(F.when(F.col("ord") == 0, F.col("lemma"))).alias("known"), F.bool_or(stop).alias("stop"))


def lemmas_of_words(words: DataFrame, dictionary: Dictionary, form_col: str = "word") -> DataFrame:
    """Adds ``lemma`` to rows of words and drops stop forms.  A compiled dictionary
    reads the words in place, whatever their number.  A small table is broadcast; of a large one only the forms that the words have go on, so that
    the rows of frequent words are not shuffled where those are few."""
    if dictionary.morphology is not None:
        read = reader(dictionary.morphology, words.sparkSession)(F.col(form_col)).alias("_read")
        return words.select("*", read).filter("NOT _read.stop").select("*", F.col("_read.lemma").alias("lemma")).drop("_read")
    forms = dictionary.forms
    if dictionary.small:
        forms = F.broadcast(forms)
    else:
        met = words.select(F.col(form_col).alias("form")).distinct()
        forms = forms.join(met, "form", "left_semi").filter(F.col("stop") | (F.col("known") != F.col("form")))
    found = words.join(forms.withColumnRenamed("form", "_form"), F.col(form_col) == F.col("_form"), "left").filter(~F.coalesce("stop", F.lit(False)))
    return found.withColumn("lemma", F.coalesce("known", form_col)).drop("_form", "known", "stop")


def term_counter(dictionary: Dictionary) -> Callable[[Column], Column]:
    """A column function: (lemma, rank) of a column of a page's words, each lemma once.
    Of a dictionary that is compiled or may be broadcast.  Batches are bounded as those
    of pages are."""
    spark = dictionary.forms.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if dictionary.morphology is not None:
        held = spark.sparkContext.broadcast(dictionary.morphology)
    else:
        # only forms that say something
        forms = dictionary.forms.filter(F.col("form").isNotNull() & (F.col("stop") | (F.col("known") != F.col("form"))))
        held = spark.sparkContext.broadcast(forms.select("form", F.coalesce("known", "form").alias("lemma"), "stop").toArrow().combine_chunks())

    def lemmas(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The lemma of each word, and whether it is indexed."""
        found = held.value
        if isinstance(found, pa.Table):
            if not found.num_rows:
                return words, np.ones(len(words), bool)
            form, lemma, stop = (c.chunk(0) for c in found.columns)
            at = pc.index_in(words, form.cast(words.type))
            return pc.coalesce(lemma.cast(words.type).take(at), words), ~pc.fill_null(stop.take(at), False).to_numpy(zero_copy_only=False)
        read = found.read(words)
        return read.field("lemma").cast(words.type), ~read.field("stop").to_numpy(zero_copy_only=False)

    @F.arrow_udf("array<struct<lemma: string, rank: float>>")
    def terms(words: pa.Array) -> pa.Array:
        flat = words.flatten()
        page = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        coded = flat.dictionary_encode()
        names, indexed = lemmas(coded.dictionary) if len(flat) else (flat, np.zeros(0, bool))
        names = names.dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False)
        kept = indexed[word]
        key, count = np.unique(page[kept] * max(1, len(names.dictionary)) + names.indices.to_numpy(zero_copy_only=False)[word[kept]], return_counts=True)
        page, lemma = np.divmod(key, max(1, len(names.dictionary)))
        rows = pa.StructArray.from_arrays([names.dictionary.take(pa.array(lemma)).cast(pa.string()), pa.array(count.astype(np.float32))], names=["lemma", "rank"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(page, np.arange(len(words) + 1)), pa.int32()), rows)

    return terms


def query_lemmas(queries: DataFrame, analyzer: Analyzer, dictionary: Dictionary | None = None) -> DataFrame:
    """(query_id, lemma), each once, of queries (query_id, query).  Blank queries
    have none."""
    from .text import clean_text

    dictionary = dictionary or Dictionary.seed(queries.sparkSession, analyzer)
    words = queries.select("query_id", F.explode(analyzer.words(clean_text(F.col("query")))).alias("word"))
    return lemmas_of_words(words, dictionary).select("query_id", "lemma").distinct()
