"""Context mixing against a plain walk over bits, the base model against counting."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnwell.llm import context_mixing as cm

from .cases import DOCS, NAMES, docs

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def symbols(texts):
    data = [t.translate(LOWER) for t in texts]
    return cm.Symbols(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def model(seed=3):
    rng = np.random.default_rng(seed)
    code = cm.Code.of(np.concatenate((rng.integers(0, 1000, 256), [17])))
    tables = [rng.integers(-100, 100, 1 << cm.TABLE_BITS).astype(np.int8) * (rng.random(1 << cm.TABLE_BITS) < 0.7) for _ in range(cm.PREDICTORS)]
    mixer = cm.Mixer(rng.normal(0.2, 0.2, (cm.PREDICTORS, cm._GATES)).astype(np.float32), rng.normal(0, 0.3, cm._GATES * cm._SIZES).astype(np.float32))
    return code, tables, mixer


def walk(text, code, tables, mixer):
    """log10 probability of one text, bit by bit."""
    seq = [*text.translate(LOWER), 256]
    own, total = np.zeros(cm.PREDICTORS), 0.0
    for begin in range(0, len(seq), cm.BLOCK):
        pull, n_bits = np.zeros(cm.PREDICTORS), 0
        for i in range(begin, min(begin + cm.BLOCK, len(seq))):
            h, contexts = 0, []
            for back in range(1, max(cm.ORDERS) + 1):
                h = (h + (seq[i - back] if i >= back else 256) + 1) * 0x2C1B3C6D & M32
                h ^= h >> 15
                if back in cm.ORDERS:
                    contexts.append(h * int(cm._ODD[len(contexts)]) & M32)
            start = i
            while start > 0 and seq[start - 1] not in SPACES:
                start -= 1
            base = 0x9E3779B97F4A7C15
            word = sum((seq[j] + 1) * pow(base, i - j, 1 << 64) for j in range(start, i)) & M64
            contexts.append((((word >> 32) ^ min(i - start, 31)) & M32) * int(cm._ODD[-1]) & M32)
            at = int(code.starts[seq[i]])
            for k in range(at, at + int(code.lengths[seq[i]])):
                place = []
                for c in contexts:
                    x = (c + int(code.nodes[k])) & M32
                    x = (x ^ x >> 13) * 0x5BD1E995 & M32
                    place.append(x >> 32 - cm.TABLE_BITS)
                odds = np.array([t[p] for t, p in zip(tables, place, strict=True)]) / 16
                gate = int(code.depths[k]) * cm._KNOWN + int((odds[1:] != 0).sum())
                z = float(odds @ mixer.weights[:, gate] + own @ odds)
                sign = 2 * int(code.bits[k]) - 1
                pull += odds * sign / (1 + math.exp(max(-30, min(30, sign * z))))
                n_bits += 1
                z += float(mixer.correction[gate * cm._SIZES + int(min(8, max(-8, z)) * 2 + 16.5)])
                total -= math.log1p(math.exp(max(-30, min(30, -sign * z))))
        own = own + cm._OWN_RATE * pull / math.sqrt(n_bits)
    return total / math.log(10)


TEXTS = [b"", b"The cat sat on the mat.", "Ünïcödé 漢字 😀".encode(), b"a b\tc\nd" * 300, b"x" * 2500, b"   \n\n  ", bytes(range(1, 128)) * 9]


@pytest.mark.parametrize("block", [1024, 100])
def test_scores_equal_a_walk(monkeypatch, block):
    monkeypatch.setattr(cm, "BLOCK", block)
    monkeypatch.setattr(cm, "_CHUNK", 700)  # texts go over several chunks
    code, tables, mixer = model()
    got = cm.score_texts(symbols(TEXTS), code, tables, mixer)
    want = [walk(t, code, tables, mixer) for t in TEXTS]
    # single precision may put a bit into the next cell of the last table
    assert np.allclose(got, want, rtol=2e-3, atol=2e-3)


def test_scores_do_not_depend_on_neighbours():
    code, tables, mixer = model()
    together = cm.score_texts(symbols(TEXTS * 3), code, tables, mixer)
    for n, text in enumerate(TEXTS):
        alone = cm.score_texts(symbols([text]), code, tables, mixer)[0]
        assert np.allclose(together[n :: len(TEXTS)], alone, rtol=1e-5)


def test_code_has_a_symbol_for_every_bit_string():
    for counts in (np.zeros(257, int), np.arange(257) ** 3, np.array([10**9, *[0] * 256])):
        code = cm.Code.of(counts)
        assert sum(2.0 ** -int(n) for n in code.lengths) == 1.0
        paths = {tuple(code.bits[a : a + n]) for a, n in zip(code.starts, code.lengths, strict=True)}
        assert len(paths) == 257


def base(rows):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)) for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    for (i, *_), ws, h in zip(rows, words, held, strict=True):
        ws = [*ws, None]
        yield i, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)


def check(spark, rows, monkeypatch, frequent):
    monkeypatch.setattr(cm, "FREQUENT", frequent)
    table = docs(spark, rows).repartition(3)
    got = cm.scored(table, cm.fit(table)).collect()
    order = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted((tuple(r) for r in got), key=order), sorted(base(rows), key=order), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0 and math.isfinite(g[6])


def test_odd_documents(spark, monkeypatch):
    assert "low" not in NAMES
    check(spark, [*DOCS, (None, None, None, None, None), *[(n, f"common words and w{n}", "en", "h", 1) for n in range(20, 60)]], monkeypatch, 1 << 16)


def test_rare_tokens_meet_their_counts(spark, monkeypatch):
    check(spark, [(n, f"common words and w{n % 7} " * (n % 3), "en", "h", 1) for n in range(60)], monkeypatch, 4)


def test_no_documents_and_no_training_rows(spark):
    empty = docs(spark, [])
    assert cm.scored(empty, cm.fit(empty)).collect() == []
    held = [n for n in range(200) if zlib.crc32(str(n).encode()) % 5 == 1][:3]
    table = docs(spark, [(n, "some text", "en", "h", 1) for n in held])
    rows = cm.scored(table, cm.fit(table)).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows} == {(True, 3, 0, 0, 0.0)}


def test_held_out_texts_are_predicted(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in cm.scored(table, cm.fit(table)).collect() if r.held_out]
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in table.collect()}
    bits = -sum(r.score for r in rows) / math.log10(2) / sum(size[r.doc_id] for r in rows)
    assert bits < 2.4  # the bytes alone have about 4.3


def test_weights_learn_on_every_training_text(spark):
    """Of each half one text that a share of one in 16 left out: nothing was learned before."""
    number = {n: zlib.crc32(str(n).encode()) for n in range(400)}
    ids = [n for n, c in number.items() if c % 5 != 1 and c // 5 % 16]
    pair = [next(n for n in ids if number[n] // 5 % 2 == half) for half in (0, 1)]
    fit = lambda *texts: cm.fit(docs(spark, [(n, t, "en", "h", 1) for n, t in zip(pair, texts, strict=True)])).mixer.weights
    one, other, changed = fit("some words " * 40, "some words " * 40), fit("some words " * 40, "words some " * 30), fit("words some " * 30, "some words " * 40)
    assert not np.allclose(one, 0.3) and not np.allclose(one, other) and not np.allclose(one, changed)


def test_learning_equals_double_precision():
    """Weights and cells in single precision against the same steps in double precision."""
    code, tables, mixer = model()
    text = symbols([t * 3 for t in TEXTS])
    weights, found = mixer.weights.astype(np.float64), np.zeros((3, cm._GATES * cm._SIZES))
    want, cells = weights.copy(), np.zeros(cm._GATES)
    total = cm._learn(text, code, tables, weights, found)
    for first, last in text.chunks():
        _, bit, depth, places = text.bits(code, first, last)
        odds = np.array([t[p] / 16 for t, p in zip(tables, places, strict=True)])
        gate = depth.astype(int) * cm._KNOWN + (odds[1:] != 0).sum(0)
        for at in range(0, len(bit), 4096):
            g, x, b = gate[at : at + 4096], odds[:, at : at + 4096], bit[at : at + 4096]
            error = b - 1 / (1 + np.exp(-(want[:, g] * x).sum(0)))
            count = np.bincount(g, minlength=cm._GATES)
            for n in range(cm.PREDICTORS):
                want[n] += cm._RATE * np.bincount(g, error * x[n], cm._GATES) / np.sqrt(count + 1)
            cells += count
    assert np.allclose(weights, want, atol=1e-4) and total == cells.sum() == found[0].sum()
    assert np.array_equal(found[0].reshape(cm._GATES, -1).sum(1), cells) and 0 < found[1].sum() < total
