import math

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tarnwell.llm import language_id, quality_classifier
from tarnwell.llm.common import mix, span_hashes, text_slices

from .cases import DOCS, docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), sample_rows=200, steps=120)


def test_language_held_out_accuracy(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(rows, model).join(rows.select("doc_id", "lang"), "doc_id").filter(language_id.remainder("doc_id", 3) == 1).toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    d = language_id.Direction(*[w.astype(np.float64) * 0.5 for w in language_id._new_direction(rng, 3)])
    rows = rng.integers(1, 4, (5, 2)).astype(np.uint8)
    weight = rng.standard_normal((5, 2, 3)).astype(np.float32)

    def loss(direction):
        h, total = np.zeros((2, 3)), 0.0
        for t in range(5):
            h = language_id._step(direction, rows[t], h)[-1]
            total += float((h * weight[t]).sum())
        return total

    _, kept = language_id._through(d, rows, range(5))
    grads = language_id._back(d, rows, range(4, -1, -1), kept, weight)
    for k in range(7):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in d[k].shape) if k > 2 else (int(rows.ravel()[rng.integers(10)]), int(rng.integers(3)))
            step = np.zeros_like(d[k])
            step[at] = 1e-4
            ahead, behind = (loss(d._replace(**{d._fields[k]: d[k] + s * step})) for s in (1, -1))
            assert abs((ahead - behind) / 2e-4 - grads[k][at]) < 2e-2


def test_language_rows(spark, model):
    got = language_id.identify(docs(spark), model).collect()
    assert len(got) == len(DOCS)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4, 8}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language_id.identify(docs(spark, []), model).count() == 0
    kept = language_id.accepted(docs(spark), model, 0.0)
    assert kept.columns == docs(spark).columns and {r.doc_id for r in kept.collect()} == {1, 5, 6, 7, 9, None}
    nothing = language_id.fit(docs(spark, []))
    assert {r.lang_pred for r in language_id.identify(docs(spark), nothing).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    names = [f"l{k:02d}" for k in range(10)]
    rows = spark.createDataFrame([(k, f"word {k}", names[min(k % 30, 9)]) for k in range(600)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, labels, steps: seen.append((sorted(set(labels)), len(texts), steps)))
    language_id.fit(rows)
    language_id.fit(rows.filter("lang < 'l04'"))
    assert [(a, c) for a, _, c in seen] == [(names, language_id.STEPS * 10 // 4), (names[:4], language_id.STEPS)]
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL", 25)
    language_id.fit(rows)
    assert seen[-1][:2] == (names, 20)
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL", 1)
    language_id.fit(rows)
    assert seen[-1][:2] == (names, 10)


def test_a_language_with_mostly_empty_texts_is_learned(spark, monkeypatch):
    df = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id < 20 THEN 'ein Wort' ELSE '' END AS text", "'de' AS lang")
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, labels, steps: seen.append(len(texts)))
    language_id.fit(df, sample_rows=30)
    assert 5 < seen[0] <= 20


def test_signs_that_are_no_letters(spark, model):
    rows = [(k, t, None, None, 0) for k, t in enumerate(["²", "½ ①", "1_2", "_", "ª", "ʰ", "²a", "漢"])]
    got = {r.doc_id: r.lang_pred == "und" for r in language_id.identify(docs(spark, rows), model).collect()}
    assert got == {k: not regex.search(r"\p{L}", t) for k, t, *_ in rows} and [got[k] for k in range(8)] == [True] * 4 + [False] * 4


def _plain_language(m, text):
    """Mean probabilities of a text, one number at a time."""
    total = [0.0] * len(m.languages)
    gate = lambda x: min(1.0, max(0.0, 0.25 * x + 0.5))

    def step(d, byte, h):
        units = range(len(h))
        dot = lambda u, i: sum(h[j] * float(u[j, i]) for j in units)
        out = []
        for i in units:
            z, r = gate(dot(d.uz, i) + float(d.xz[byte, i])), gate(dot(d.ur, i) + float(d.xr[byte, i]))
            c = min(1.0, max(-1.0, r * (dot(d.uc, i) + float(d.bc[i])) + float(d.xc[byte, i])))
            out.append(h[i] + z * (c - h[i]))
        return out

    for first in range(0, len(text), language_id.STRETCH):
        piece = text[first : first + language_id.STRETCH]
        padded = piece + b"\0" * (language_id.STRETCH - len(piece))
        ahead, h = [], [0.0] * m.ahead.bc.size
        for byte in padded:
            h = step(m.ahead, byte, h)
            ahead.append(h)
        h = [0.0] * m.back.bc.size
        for t in reversed(range(len(padded))):
            h = step(m.back, padded[t], h)
            if t < len(piece):
                both = ahead[t] + h
                logits = [sum(both[j] * float(m.out[j, k]) for j in range(len(both))) + float(m.bias[k]) for k in range(len(total))]
                raised = [math.exp(x - max(logits)) for x in logits]
                total = [a + b / sum(raised) for a, b in zip(total, raised, strict=True)]
    return [x / max(1, len(text)) for x in total]


def test_language_equals_plain_network(model):
    texts = ["", "the", "Les éléments que nous avons étudiés sont là, et voilà.", "der Hund und die Katze schlafen, " * 4, "漢字 😀"]
    (s,) = text_slices(pa.array(texts))
    got = language_id.pooled(model, s.data, s.offsets)
    for k, text in enumerate(texts):
        assert np.allclose(got[k], _plain_language(model, text.encode()), atol=1e-4)


def _plain_quality(m, text):
    """The score of a text from its features, one by one."""
    spaces = b" \t\n\x0b\x0c\r"
    words = text.split()
    slot = lambda word: int(span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]) % quality_classifier.SLOTS
    hashed = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0]) % quality_classifier.SLOTS
    slots = [slot(w) for w in words]
    for back in quality_classifier.AGAIN:
        slots += [hashed(back)] * sum(words[k] == words[k - back] for k in range(back, len(words)))
    flat = bytes(0x20 if b in spaces else b for b in text)
    for n in quality_classifier.GRAMS:
        for k in range(len(flat) - n + 1):
            if not any(b in spaces for b in text[k + 1 : k + n - 1]):
                slots.append(hashed(int.from_bytes(flat[k : k + n], "big") + n))
    weight = [float(m.vectors[s] @ (m.layer[:, 1] - m.layer[:, 0])) for s in slots]
    return 1 / (1 + math.exp(-(sum(weight) / max(1, len(weight)) + float(m.bias[1] - m.bias[0]))))


def test_quality_equals_plain_sum():
    rng = np.random.default_rng(3)
    m = quality_classifier.Model(rng.standard_normal((quality_classifier.SLOTS, quality_classifier.DIM)).astype(np.float32), rng.standard_normal((quality_classifier.DIM, 2)).astype(np.float32), rng.standard_normal(2).astype(np.float32))
    texts = ["", " \n\t", "a", "ab", "again again and again and\nagain", "ünï  cödé\x0bx", "a longer wordthatisverylongindeed " * 3]
    (s,) = text_slices(pa.array(texts))
    got = quality_classifier.scores(m, s.data, s.offsets)
    for k, text in enumerate(texts):
        assert abs(got[k] - _plain_quality(m, text.encode())) < 1e-5, text


def test_one_text_of_a_repeated_id_is_learned(spark, monkeypatch):
    rows = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1)], "doc_id long, quality int").filter(quality_classifier.remainder("doc_id", 4) != 2)
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda texts, labels, epochs: seen.append(sorted(labels)))
    quality_classifier.fit(rows, labels)
    quality_classifier.fit(rows.repartition(5), labels)
    assert seen[0] == seen[1] and len(seen[0]) <= 2


def test_whole_text_counts(model):
    french = "Les éléments que nous avons étudiés sont des éléments. " * 400
    texts = ["of the and that with " * 50 + french, french]
    (s,) = text_slices(pa.array(texts))
    pooled = language_id.pooled(model, s.data, s.offsets)
    parts = [language_id.pooled(model, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts]
    assert np.allclose(pooled, np.concatenate(parts), atol=1e-5) and abs(pooled.sum(1) - 1).max() < 1e-4


def test_quality_held_out_accuracy(spark):
    rows, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.op5_quality_classifier(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").toPandas()
    assert rows.columns[0] == "doc_id" and len(got) > 800
    assert (got.predicted == got.quality).mean() > 0.98 and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_quality_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (7, None), (None, 0), (8, 0), (8, 0)], "doc_id long, quality int").withColumn("order", F.lit(1))
    model = quality_classifier.fit(docs(spark), labels)
    got = quality_classifier.score(docs(spark), model).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    empty = {round(r.score, 9) for r in got if r.doc_id in (2, 3)}
    assert len(empty) == 1
    none = quality_classifier.fit(docs(spark, []), labels)
    assert {r.score for r in quality_classifier.score(docs(spark), none).collect()} == {0.5}
    assert quality_classifier.score(docs(spark, []), model).count() == 0
    assert quality_classifier.accepted(docs(spark), none).count() == 0
