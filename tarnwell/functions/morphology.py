"""Morphology compiled from a dictionary table: known forms by an automaton, unknown
ones by their endings.

A form's lemma is a rule: how many letters to take off its end and what to put on
instead.  Forms of one paradigm share few rules, so the automaton of (form, rule and
stop class) folds the endings of a whole language into few states.  The guesser is a
second automaton, over endings read backwards: each ending of up to ``ENDING``
letters that at least ``LEAST`` forms have stands for its most frequent rule (ties: the
smaller cut, then the smaller addition), and the longest ending that is known decides.
An ending whose rule is that of the next shorter one is left out, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.automaton import MOST_EDGES, Automaton, TooLarge, build
from ..sources.scratch import stored

ENDING = 5
LEAST = 3
MOST_RULES = 1_000_000


NEAR = 8


def rule_of(form: Column, lemma: Column) -> tuple[Column, Column]:
    """(cut, add): letters to take off a form's end, and what comes instead.  Most
    rules cut few letters and are found by comparing beginnings; for others the shared
    beginning is counted letter by letter."""
    size = F.length(form)
    n = F.least(size, F.length(lemma))
    same = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda k, i: F.when((i > 0) & (k == i - 1) & (F.substring(form, i, F.lit(1)) == F.substring(lemma, i, F.lit(1))), i).otherwise(k))
    cut = F.when(lemma.startswith(form), 0)
    for k in range(1, NEAR + 1):
        cut = cut.when((size >= k) & lemma.startswith(F.substring(form, F.lit(1), size - k)), k)
    cut = cut.otherwise(size - same)
    return cut, F.substring(lemma, size - cut + 1, F.length(lemma))


def with_rules(forms: DataFrame) -> DataFrame:
    """(form, cut, add, stop) of (form, known, stop); a form without a lemma stays."""
    cut, add = rule_of(F.col("form"), F.col("lemma"))
    return forms.filter("form IS NOT NULL").select("form", F.coalesce("known", "form").alias("lemma"), F.coalesce("stop", F.lit(False)).alias("stop")).select("form", cut.cast("int").alias("cut"), add.alias("add"), "stop")


def endings(rules: DataFrame, longest: int = ENDING, least: int = LEAST) -> DataFrame:
    """(ending, cut, add): the most frequent rule of each ending that ``least`` forms
    have; stop forms and rules that cut into what stands before the ending don't count."""
    cut = rules.filter("NOT stop").select("cut", "add", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("form"), F.lit(longest))), lambda n: F.right(F.col("form"), n))).alias("ending"))
    counts = cut.filter("cut <= length(ending)").groupBy("ending", "cut", "add").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "cut", "add")).alias("best")
    return counts.groupBy("ending").agg(best, F.sum("n").alias("all")).filter(F.col("all") >= least).select("ending", "best.cut", "best.add")


def _needed(found: DataFrame) -> DataFrame:
    """Without the endings whose rule is that of the ending less its first letter."""
    shorter = found.select(F.col("ending").alias("_shorter"), F.col("cut").alias("_cut"), F.col("add").alias("_add"))
    met = found.join(shorter, F.substring("ending", 2, ENDING * 100) == F.col("_shorter"), "left")
    same = (F.col("cut") == F.col("_cut")) & (F.col("add") == F.col("_add"))
    return met.filter(~F.coalesce(same, F.lit(False))).select("ending", "cut", "add")


@dataclass(frozen=True)
class Morphology:
    """rules: (cut, add, stop) by number; ``guesser`` may be missing."""

    forms: Automaton
    guesser: Automaton | None
    rules: tuple[tuple[int, str, bool], ...]

    @property
    def n_bytes(self) -> int:
        return self.forms.n_bytes + (self.guesser.n_bytes if self.guesser else 0)

    def read(self, words: pa.Array) -> pa.Array:
        """(lemma, stop, known) of each word; of an unknown one the guessed lemma, or
        the word itself.  A null has none."""
        distinct = words.dictionary_encode()
        own = distinct.dictionary
        if not len(own):
            return pa.array([None] * len(words), READING)
        rule = self.forms.walk(own)
        known = rule >= 0
        if self.guesser is not None and not known.all():
            rule[~known] = self.guesser.walk(pc.utf8_reverse(own.filter(pa.array(~known))), longest=True)
        lemmas, stops = own.to_pylist(), [False] * len(own)
        for n, (word, r) in enumerate(zip(lemmas, rule.tolist(), strict=True)):
            if r >= 0:
                cut, add, stops[n] = self.rules[r]
                lemmas[n] = (word[: len(word) - cut] + add if cut or add else word) or word
        readings = pa.StructArray.from_arrays([pa.array(lemmas, pa.string()), pa.array(stops), pa.array(known)], fields=list(READING))
        return readings.take(distinct.indices)


READING = pa.struct([("lemma", pa.string()), ("stop", pa.bool_()), ("known", pa.bool_())])


def compiled(forms: DataFrame, guess: bool = False, most_edges: int = MOST_EDGES) -> Morphology:
    """The morphology of (form, known, stop), one row a form: known forms have the
    lemma ``known`` (their own where it is null).  Raises ``TooLarge`` beyond
    ``most_edges`` or a million different rules."""
    spark = forms.sparkSession
    rules = stored(with_rules(forms), "rules")
    found = rules.select("cut", "add", "stop").distinct().limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise TooLarge(f"more than {MOST_RULES} rules")
    table = sorted((r.cut, r.add, r.stop) for r in found)
    schema = "cut int, add string, stop boolean, output int"
    numbers = F.broadcast(spark.createDataFrame([(*r, n) for n, r in enumerate(table)], schema))
    known = build(rules.join(numbers, ["cut", "add", "stop"]).select(F.col("form").alias("key"), "output"), most_edges)
    guesser = None
    if guess:
        of_endings = _needed(endings(rules)).join(numbers.filter("NOT stop"), ["cut", "add"])
        guesser = build(of_endings.select(F.reverse("ending").alias("key"), "output"), most_edges)
    return Morphology(known, guesser, tuple(table))


def reader(morphology: Morphology, spark) -> Callable[[Column], Column]:
    """A column function: (lemma, stop, known) of a column of words."""
    held = spark.sparkContext.broadcast(morphology)

    @F.arrow_udf("lemma string, stop boolean, known boolean")
    def read(words: pa.Array) -> pa.Array:
        return held.value.read(words)

    return read
