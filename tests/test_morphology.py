"""The automaton against a dict, the guesser against plain counting of endings."""

from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.functions.analyzer import MORPH_SCHEMA, RUSSIAN, Dictionary, lemmas_of_words
from tarnwell.functions.morphology import ENDING, LEAST, compiled, reader
from tarnwell.operators.automaton import Automaton, TooLarge, build

ODD = ["", "a", "ab", "abc", "b", "ё", "мельницы", "😀", "😀a", "a\x00b", "zz", "é", "é", "x" * 300]


def automaton(spark, strings, partitions=3) -> Automaton:
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return build(spark.createDataFrame(strings, "key string, output int"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def minimal(strings):
    """The number of states and edges of the minimal automaton."""
    trie = {}
    for key, output in strings:
        for n in range(len(key) + 1):
            trie.setdefault(key[:n], [None, {}])
            if n:
                trie[key[: n - 1]][1][key[n - 1]] = key[:n]
        trie[key][0] = output
    name, seen = {}, {}
    for prefix in sorted(trie, key=len, reverse=True):
        output, edges = trie[prefix]
        sign = (output, tuple(sorted((c, name[p]) for c, p in edges.items())))
        name[prefix] = seen.setdefault(sign, len(seen))
    return len(seen), sum(len(edges) for _, edges in seen)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_holds_what_it_was_given(spark, partitions):
    strings = [(w, n % 3) for n, w in enumerate(ODD)]
    got = automaton(spark, strings, partitions)
    asked = pa.array([*ODD, "ac", "abcd", "мельниц", "\U0001f601", "x" * 299, "xy"])
    assert got.walk(asked).tolist() == [n % 3 for n in range(len(ODD))] + [-1] * 6
    assert (len(got.outputs), len(got.edges)) == minimal(strings)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abc", max_size=6), st.integers(0, 2), max_size=60), st.lists(st.text("abcd", max_size=7), max_size=20))
def test_equals_a_dict_and_is_minimal(spark, strings, others):
    got = automaton(spark, list(strings.items()))
    asked = [*strings, *others, ""]
    assert got.walk(pa.array(asked, pa.string())).tolist() == [strings.get(w, -1) for w in asked]
    longest = [next((strings[w[:n]] for n in range(len(w), -1, -1) if w[:n] in strings), -1) for w in asked]
    assert got.walk(pa.array(asked, pa.string()), longest=True).tolist() == longest
    if strings:
        assert (len(got.outputs), len(got.edges)) == minimal(strings.items())


def test_empty_nulls_and_bound(spark):
    empty = automaton(spark, [])
    assert empty.walk(pa.array(["", "a"])).tolist() == [-1, -1]
    assert automaton(spark, [(None, 1), ("a", None), ("b", 1)]).walk(pa.array(["a", "b"])).tolist() == [-1, 1]
    with pytest.raises(TooLarge):
        build(spark.createDataFrame([("abc", 1), ("xyz", 2)], "key string, output int"), most_edges=4)


MORPH = [
    *RUSSIAN.morph, ("лучшие", "хороший", "П", 0), ("лучшие", "лучший", "П", 1), ("мой", "мыть", "Г", 0), ("мой", "мой", "МС", 1),
    ("без", None, "ПРЕДЛ", 0), ("слово", None, "С", 0), ("вторая", "иная", "П", 1), (None, "пусто", "С", 0),
]


def test_equals_the_join(spark):
    dictionary = Dictionary.of(spark.createDataFrame(MORPH, MORPH_SCHEMA))
    words = [m[0] for m in MORPH] + ["неизвестное", "", None, "мельниц", "лучшие", "лучшие"]
    rows = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, word string").filter("word IS NOT NULL")
    joined, read = (sorted(tuple(r) for r in lemmas_of_words(rows, d).select("n", "word", "lemma").collect()) for d in (dictionary, dictionary.compile()))
    assert joined == read and len(read) > 15
    as_join, as_automaton = dictionary.readings(rows), dictionary.compile().readings(rows)
    assert as_join[1] == as_automaton[1]
    assert as_join[0].items() <= as_automaton[0].items()


def test_too_large_falls_back_to_the_join(spark, monkeypatch):
    from tarnwell.functions import analyzer

    def refuse(*_):
        raise TooLarge("too large")

    monkeypatch.setattr(analyzer, "compiled", refuse)
    assert Dictionary.of(spark.createDataFrame(MORPH, MORPH_SCHEMA)).compile().morphology is None


def paradigms(spark, n):
    """Stems of three kinds with the endings of each."""
    kinds = [("", ["", "s", "'s"]), ("a", ["a", "y", "u", "oj", "ami"]), ("yj", ["yj", "aja", "oje", "yh", "ymi"])]
    rows = []
    for k in range(n):
        stem, x = "", k * 7919 + 13
        while x:
            stem, x = stem + "bdgklmnprt"[x % 10] + "aeiou"[x % 5], x // 10
        lemma, endings = kinds[k % 3]
        rows += [(stem + e, stem + lemma, False) for e in endings]
    return list({r[0]: r for r in rows}.values())


def test_guesses_held_out_forms(spark):
    rows = paradigms(spark, 1500)
    known, held = [r for n, r in enumerate(rows) if n % 5], [r for n, r in enumerate(rows) if not n % 5]
    schema = "form string, known string, stop boolean"
    read = reader(compiled(spark.createDataFrame(known, schema), guess=True), spark)
    got = {r.form: r for r in spark.createDataFrame(held, schema).select("form", "known", read(F.col("form")).alias("r")).select("form", "known", F.col("r.lemma").alias("lemma"), F.col("r.known").alias("seen")).collect()}

    counts = Counter()
    for form, lemma, _ in known:
        same = next((n for n, (a, b) in enumerate(zip(form, lemma, strict=False)) if a != b), min(len(form), len(lemma)))
        for n in range(1, min(ENDING, len(form)) + 1):
            if len(form) - same <= n:
                counts[form[-n:], len(form) - same, lemma[same:]] += 1
    best = {}
    for (ending, cut, add), n in counts.items():
        best.setdefault(ending, []).append((-n, cut, add))
    for form, _, _ in held:
        rule = next((min(best[form[-n:]])[1:] for n in range(ENDING, 0, -1) if sum(-x[0] for x in best.get(form[-n:], [])) >= LEAST), (0, ""))
        assert got[form].lemma == (form[: len(form) - rule[0]] + rule[1] or form) and not got[form].seen
    right = sum(r.lemma == r.known for r in got.values()) / len(got)
    assert right > 0.9
