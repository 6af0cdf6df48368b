"""Language identification (operator 1): a bidirectional gated recurrent network
over bytes, trained in numpy by backpropagation through time.

Two GRUs read a stretch of 64 bytes, one in each direction; their states give
every position a probability of each language.  A document's probabilities are
the means over all its positions.  Gates and states are piecewise linear (clipped)
instead of sigmoid and tanh, which makes a step a few cheap numpy passes.

Long texts are cut into stretches that are read side by side, so the time of a
slice depends on its bytes alone and every byte of a text is labelled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat_ranges, hash_below, map_arrow, text_slices

STRETCH = 64
HIDDEN = 12
BATCH = 4096  # stretches read side by side
CELLS = 1 << 21  # and fewer where there are many languages: probabilities in a step
UNKNOWN = "und"
#: Bounds of the training sample: rows of each language, rows of all (but one of
#: each language at least), and characters of each row.
SAMPLE_ROWS = 600
SAMPLE_TOTAL = 300_000
SAMPLE_CHARS = 512
#: Training steps for up to FEW languages; more languages get more in proportion.
STEPS = 300
FEW = 4
_LETTER = regex.compile(r"\p{L}")


class Direction(NamedTuple):
    """Input tables of 256 bytes and recurrent weights of the gates z, r and of
    the candidate state c."""

    xz: np.ndarray
    xr: np.ndarray
    xc: np.ndarray
    uz: np.ndarray
    ur: np.ndarray
    uc: np.ndarray
    bc: np.ndarray


class Model(NamedTuple):
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # 2 * HIDDEN x languages
    bias: np.ndarray


def _gate(x: np.ndarray) -> np.ndarray:
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def _step(d: Direction, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    z = _gate(h @ d.uz + d.xz.take(byte, axis=0))
    r = _gate(h @ d.ur + d.xr.take(byte, axis=0))
    q = h @ d.uc
    q += d.bc
    c = r * q
    c += d.xc.take(byte, axis=0)
    np.clip(c, -1, 1, out=c)
    return z, r, q, c, h + z * (c - h)


def _probabilities(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def _positions(m: Model, stretches: np.ndarray):
    """Probabilities of the languages at each position, last position first."""
    n, length = stretches.shape
    steps = np.ascontiguousarray(stretches.T)
    states = np.empty((length, n, m.ahead.bc.size), np.float32)
    h = np.zeros((n, m.ahead.bc.size), np.float32)
    for t in range(length):
        h = states[t] = _step(m.ahead, steps[t], h)[-1]
    h = np.zeros_like(h)
    for t in reversed(range(length)):
        h = _step(m.back, steps[t], h)[-1]
        yield t, _probabilities(states[t] @ m.out[: h.shape[1]] + h @ m.out[h.shape[1] :] + m.bias)


def pooled(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities of each document; zeros for one without bytes."""
    size = np.diff(offsets)
    pieces = -(-size // STRETCH)
    start = np.repeat(offsets[:-1], pieces) + flat_ranges(np.zeros(len(size), np.int64), pieces) * STRETCH
    length = np.minimum(np.repeat(offsets[1:], pieces) - start, STRETCH)
    owner = np.repeat(np.arange(len(size)), pieces)
    total = np.zeros((len(size), len(m.languages)))
    padded = np.concatenate((data, np.zeros(STRETCH, np.uint8)))
    batch = max(64, min(BATCH, CELLS // max(1, len(m.languages))))
    for k in range(0, len(start), batch):
        own = length[k : k + batch]
        stretches = padded[start[k : k + batch, None] + np.arange(STRETCH)]
        stretches[np.arange(STRETCH) >= own[:, None]] = 0
        sums = np.zeros((len(own), len(m.languages)), np.float32)
        full = int(own.min())
        for t, p in _positions(m, stretches):
            if t >= full:
                p *= (t < own)[:, None]
            sums += p
        np.add.at(total, owner[k : k + batch], sums)
    return total / np.maximum(size, 1)[:, None]


def _new_direction(rng: np.random.Generator, hidden: int) -> list[np.ndarray]:
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    return [draw(256, hidden, by=0.5), draw(256, hidden, by=0.5), draw(256, hidden, by=0.7), *(draw(hidden, hidden, by=hidden**-0.5) for _ in range(3)), np.zeros(hidden, np.float32)]


def _through(d: Direction, steps: np.ndarray, order) -> tuple[np.ndarray, list]:
    n, hidden = steps.shape[1], d.bc.size
    states, kept, h = np.empty((len(steps), n, hidden), np.float32), {}, np.zeros((n, hidden), np.float32)
    for t in order:
        z, r, q, c, new = _step(d, steps[t], h)
        kept[t] = (h, z, r, q, c)
        h = states[t] = new
    return states, kept


def _back(d: Direction, steps: np.ndarray, order, kept: dict, above: np.ndarray) -> list[np.ndarray]:
    """Gradients of a direction; ``above`` are those of its states from outside."""
    grads = [np.zeros_like(x) for x in d]
    flows = np.empty((3, *above.shape), np.float32)
    dh = np.zeros_like(above[0])
    for t in order:
        h, z, r, q, c = kept[t]
        dh = dh + above[t]
        dz = dh * (c - h) * (0.25 * ((z > 0) & (z < 1)))
        dc = dh * z * (np.abs(c) < 1)
        dr = dc * q * (0.25 * ((r > 0) & (r < 1)))
        dq = dc * r
        flows[0, t], flows[1, t], flows[2, t] = dz, dr, dc
        grads[3] += h.T @ dz
        grads[4] += h.T @ dr
        grads[5] += h.T @ dq
        grads[6] += dq.sum(0)
        dh = dh * (1 - z) + dz @ d.uz.T + dr @ d.ur.T + dq @ d.uc.T
    byte = steps.ravel()
    for k in range(3):
        np.add.at(grads[k], byte, flows[k].reshape(len(byte), -1))
    return grads


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 11, batch: int = 128) -> Model:
    """A model by Adam on random stretches of the texts, a label an equal share
    of each batch; every position of a stretch has the label of its text."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    weights = [*_new_direction(rng, hidden), *_new_direction(rng, hidden), (rng.standard_normal((2 * hidden, len(languages))) * 0.3).astype(np.float32), np.zeros(len(languages), np.float32)]
    build = lambda: Model(languages, Direction(*weights[:7]), Direction(*weights[7:14]), weights[14], weights[15])
    of = [[np.frombuffer(t, np.uint8) for t, own in zip(texts, labels, strict=True) if own == language and t] for language in languages]
    if not languages or not all(of):
        return build()
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, steps + 1):
        wanted = rng.integers(0, len(languages), batch)
        stretches = np.zeros((batch, STRETCH), np.uint8)
        for k, language in enumerate(wanted):
            text = of[language][rng.integers(len(of[language]))]
            begin = rng.integers(max(1, len(text) - STRETCH // 2))
            piece = text[begin : begin + (STRETCH if rng.random() < 0.8 else rng.integers(3, STRETCH))]
            stretches[k, : len(piece)] = piece
        m, rows = build(), np.ascontiguousarray(stretches.T)
        forth, back = range(STRETCH), range(STRETCH - 1, -1, -1)
        ahead, ahead_kept = _through(m.ahead, rows, forth)
        behind, behind_kept = _through(m.back, rows, back)
        both = np.concatenate((ahead, behind), axis=2)
        error = _probabilities(both @ m.out + m.bias)
        error[:, np.arange(batch), wanted] -= 1
        error *= (rows > 0)[..., None]
        error /= max(1, int((rows > 0).sum()))
        above = error @ m.out.T
        grads = [
            *_back(m.ahead, rows, back, ahead_kept, above[..., :hidden]), *_back(m.back, rows, forth, behind_kept, above[..., hidden:]),
            np.tensordot(both, error, axes=((0, 1), (0, 1))), error.sum((0, 1)),
        ]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            g = g / max(1.0, norm)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return build()


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, steps: int | None = None) -> Model:
    """Learn from rows with a language, a text that isn't empty and an id whose
    crc32 modulo 3 is not 1: of each language the ``sample_rows`` rows (fewer if
    that came to more than SAMPLE_TOTAL) with the smallest hash of the id, and of
    each of them SAMPLE_CHARS characters from a hashed place.  Every language that
    occurs is learned.  Without ``steps`` they grow with the languages, so that
    each has its share of stretches.  No such rows give a model without
    languages."""
    order, text = F.xxhash64(F.col(id_col).cast("string")), F.col(text_col)
    place = F.pmod(order, F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = docs.filter((remainder(id_col, 3) != 1) & F.col(lang_col).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), order.alias("order"), text.alias("text"), place.alias("place"))
    totals = rows.groupBy("lang").agg(F.count("*").alias("total")).collect()  # a row for each language
    sample_rows = max(1, min(sample_rows, SAMPLE_TOTAL // max(1, len(totals))))
    counts = docs.sparkSession.createDataFrame(totals, "lang string, total long")
    rows = rows.join(F.broadcast(counts), "lang").filter(hash_below(F.col("order"), sample_rows, F.col("total")))
    rows = rows.select("lang", "order", F.substring("text", F.col("place"), F.lit(SAMPLE_CHARS)).alias("text"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text")))
    sample = ranked.filter(F.col("rank") <= sample_rows).select("lang", "order", "text").collect()
    sample = sorted((r.lang, r.order, r.text) for r in sample)
    if steps is None:
        steps = STEPS * max(FEW, len({lang for lang, _, _ in sample})) // FEW
    return train([t.encode() for _, _, t in sample], [lang for lang, _, _ in sample], steps)


def _judged(m: Model, s) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each document of a slice, -1 for none; score."""
    n = s.last - s.first
    if not m.languages:
        return np.full(n, -1), np.zeros(n)
    p = pooled(m, s.data, s.offsets)
    raw, at = s.data.tobytes(), s.offsets.tolist()
    letters = np.array([bool(_LETTER.search(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(at[:-1], at[1:], strict=True)], bool)
    best = p.argmax(1)
    return np.where(letters, best, -1), np.where(letters, p[np.arange(n), best], 0.0).clip(0, 1)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred and score.

    Texts that are null or hold no letter are `und` with score 0, as is every
    text where nothing was learned; equal texts get equal results (of equal
    probabilities the language first in the alphabet).  Null ids and repeated
    rows are kept; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            found = [_judged(m, s) for s in text_slices(batch.column("text"))]
            best = np.concatenate([np.zeros(0, np.int64), *(b for b, _ in found)]).astype(np.int64)
            score = np.concatenate([np.zeros(0), *(p for _, p in found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, label, f"doc_id {id_type}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float, languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are in one of ``languages`` (any
    learned one if None) with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def keep(batches):
        m = shared.value
        good = np.array([languages is None or x in languages for x in m.languages] + [False])
        for batch in batches:
            masks = [good[best] & (score >= least) for best, score in (_judged(m, s) for s in text_slices(batch.column(column)))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *masks])))

    return map_arrow(docs, keep, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = identify(docs, fit(docs))
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
