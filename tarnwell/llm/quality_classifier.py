"""Quality classifier (operator 5): supervised subword embeddings.

A document is the average of learned vectors of its words, of the byte n-grams
of its words, and of word pairs that say the same word again, all hashed into one
table; a softmax layer makes it the probability of label 1.  Table and layer are trained by numpy stochastic gradient
descent.  As the layer is linear in the average, the table times the layer is
one number a slot, and scoring adds up numbers instead of vectors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, hash_below, map_arrow, mix, span_hashes, text_slices, words_of
from .language_id import remainder

SLOTS = 1 << 16
DIM = 8
GRAMS = (3, 4)
AGAIN = (1, 2, 3)  # words back to an equal word
THRESHOLD = 0.7
#: Bounds of the training sample: rows of each label, and characters of each.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 6000
EPOCHS = 6
RATE = 8.0


class Model(NamedTuple):
    vectors: np.ndarray  # SLOTS x DIM
    layer: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features, and the byte position each begins at, unordered.
    White space of any kind is one sign; a gram may begin or end with it."""
    start, end, bounds = words_of(data, offsets, NOT_SPACE)
    words = span_hashes(data, start, end)
    slots, place = [(words & np.uint64(SLOTS - 1)).astype(np.int64)], [start]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for back in AGAIN:
        at = np.flatnonzero((words[back:] == words[:-back]) & (owner[back:] == owner[:-back])) + back
        slots.append(np.full(len(at), int(mix(np.array([back], np.uint64))[0]) % SLOTS))
        place.append(start[at])
    flat = np.where(NOT_SPACE[data], data, np.uint8(0x20)).astype(np.uint64)
    inner = NOT_SPACE[data]
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    for n in GRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        code = np.zeros(count, np.uint64)
        good = np.arange(n, len(data) + 1) <= owner_end[:count]
        for k in range(n):
            code = (code << np.uint64(8)) | flat[k : k + count]
            if 0 < k < n - 1:
                good &= inner[k : k + count]
        at = np.flatnonzero(good)
        slots.append((mix(code[at] + np.uint64(n)) & np.uint64(SLOTS - 1)).astype(np.int64))
        place.append(at)
    return np.concatenate(slots), np.concatenate(place)


def scores(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each document."""
    weight = (m.vectors @ (m.layer[:, 1] - m.layer[:, 0])).astype(np.float64)
    slots, place = _features(data, offsets)
    by_byte = np.bincount(place, weights=weight[slots], minlength=len(data)) if len(data) else np.zeros(0)
    many = np.bincount(place, minlength=len(data)) if len(data) else np.zeros(0, np.int64)
    totals = []
    for values in (by_byte, many):
        sums = np.concatenate(([0], np.cumsum(values)))
        totals.append(sums[offsets[1:]] - sums[offsets[:-1]])
    logit = totals[0] / np.maximum(totals[1], 1) + float(m.bias[1] - m.bias[0])
    return 1 / (1 + np.exp(-logit.clip(-500, 500)))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Stochastic gradient descent, one example a step: whole texts and, as often,
    a stretch of a few words, so that short documents are like training ones."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (SLOTS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    examples = []
    for text, label in zip(texts, labels, strict=True):
        pieces = [text]
        words = text.split()
        if len(words) > 6:
            first = int(rng.integers(len(words) - 5))
            pieces.append(b" ".join(words[first : first + int(rng.integers(3, 30))]))
        for piece in pieces:
            data = np.frombuffer(piece, np.uint8)
            slots, many = np.unique(_features(data, np.array([0, len(data)]))[0], return_counts=True)
            if len(slots):
                examples.append((slots, (many / many.sum()).astype(np.float32), int(label)))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            slots, share, label = examples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[slots]
            p = mean @ layer + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= 0.1 * rate * np.outer(mean, p)
            bias -= 0.01 * rate * p
            vectors[slots] -= rate * np.outer(share, back)
    return Model(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Model:
    """Learn from labelled rows whose crc32 of the id modulo 4 is not 2: of each
    label the ``sample_rows`` rows with the smallest hash of the id, and of each
    text SAMPLE_CHARS characters from a hashed place.  Null labels, ids and
    texts are left out; of rows with equal ids the text with the smallest hash
    counts; without rows every score is one half."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    known = labels.filter((remainder(id_col, 4) != 2) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"), order.alias("order")).distinct()
    totals = dict(known.groupBy("label").count().collect())
    near = [known.filter((F.col("label") == k) & hash_below(F.col("order"), sample_rows, F.lit(totals.get(k, 0)))) for k in (0, 1)]
    chosen = [rows.orderBy("order", "doc_id").limit(sample_rows) for rows in near]
    ids = chosen[0].unionByName(chosen[1])  # at most 2 * sample_rows rows
    text = F.col(text_col)
    place = F.pmod(order, F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.substring(text, place, F.lit(SAMPLE_CHARS)).alias("text")).filter("text IS NOT NULL")
    # one text an id, however many rows have it
    chosen_rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "order", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = sorted((r.order, r.label, r.text) for r in chosen_rows.select("order", "label", "text").collect())
    return train([t.encode() for _, _, t in sample], [k for _, k, _ in sample], epochs)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, score and predicted.

    Null and empty texts get the score of no features, the layer's bias alone.
    Equal texts get equal scores; null ids and repeated rows are kept; an empty
    table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            found = np.concatenate([np.zeros(0), *(scores(shared.value, s.data, s.offsets) for s in text_slices(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, judge, f"doc_id {id_type}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with at least the threshold's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            masks = [scores(shared.value, s.data, s.offsets) >= threshold for s in text_slices(batch.column(column))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *masks])))

    return map_arrow(docs, keep, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
