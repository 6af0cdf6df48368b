"""Quality rules (operator 10): cross-document line frequency.

Lines are normalised (A-Z lower-cased, words only) and hashed; for each host the
distinct documents that hold a line are counted.  A line in at least ``many_docs``
documents, or in at least ``min_docs`` that are ``min_share`` percent of the host's
documents, is boilerplate and is removed; a document is rejected when less than
``min_left_share`` percent or ``min_left_words`` of its words are left.  Before
that, base rules fail documents that are too short or repeat themselves.

A text is read once.  That pass measures it and leaves its distinct lines as
128-bit digests with their numbers of words, in a table in the shared folder; all
after that is joins of digests.  A document gives each of its lines once, and Spark
sums before it shuffles, so a line in a third of all documents costs no more than
any other; nothing is kept by host, so a host may have any number of lines.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import row_number, stored
from .common import NOT_SPACE, chained, fold, map_arrow, segment_sums, span_keys, text_slices, window_hashes, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_SHARE = 20
#: A line that so many documents of a host hold is the host's and not theirs, however
#: large the host; on a small host a tenth of its documents will do, five at least.
MANY_DOCS = 30
MIN_DOCS = 5
MIN_SHARE = 10
#: A document that loses half of its words to such lines has no body of its own, and
#: what is left must have as many words as any document.
MIN_LEFT_SHARE = 50
MIN_LEFT_WORDS = MIN_WORDS

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NOT_CONTINUED = (np.arange(256) & 0xC0) != 0x80


def _found_twice(owner: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which windows, beginning at the words ``first``, their owner has more than
    once.  Windows of one hash are compared word by word; should two differ, all
    are sorted by their words."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    at = np.flatnonzero(same)
    a, b = order[at], order[at + 1]
    equal = owner[a] == owner[b]
    for k in range(WINDOW):
        equal &= (low[first[a] + k] == low[first[b] + k]) & (high[first[a] + k] == high[first[b] + k])
    if not equal.all():
        columns = [x[first + k] for k in range(WINDOW) for x in (low, high)] + [owner]
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in columns])
    twice = np.zeros(len(order), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice


def _normal(line: bytes) -> list[bytes]:
    """The words of a line, A-Z lower-cased; both steps know ASCII only."""
    return line.lower().split()


def _digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def _lines(text: bytes) -> tuple[int, dict[bytes, int]]:
    """How many lines with a word are equal to an earlier one, and the words in
    each distinct normalised line, all its occurrences together."""
    seen: set[bytes] = set()
    own: dict[bytes, int] = {}
    many = 0
    for line in text.split(b"\n"):
        words = _normal(line)
        if words:
            many += 1
            seen.add(line)
            name = _digest(words)
            own[name] = own.get(name, 0) + len(words)
    return many - len(seen), own


LINES = "array<struct<one: long, two: long, n: long>>"
_LINE = pa.struct([("one", pa.int64()), ("two", pa.int64()), ("n", pa.int64())])


def _measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines
    to rows (doc_id, text, host, ...)."""

    def measure(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            lists, names, words_in = [0], [], []
            for s in text_slices(batch.column("text")):
                n = s.last - s.first
                start, end, bounds = words_of(s.data, s.offsets, NOT_SPACE)
                low, high = span_keys(s.data, start, end)
                n_words = np.diff(bounds)
                owner = np.repeat(np.arange(n), n_words)
                hashes = window_hashes(fold(low, high), WINDOW)
                first = np.flatnonzero(owner[: len(hashes)] == owner[WINDOW - 1 :]) if len(hashes) else np.zeros(0, np.int64)
                twice = first[_found_twice(owner[first], first, low, high, chained(hashes[first], owner[first].astype(np.uint64)))]
                mark = np.zeros(len(start) + 1, np.int64)
                np.add.at(mark, twice, 1)
                np.add.at(mark, twice + WINDOW, -1)
                raw, at, again = s.data.tobytes(), s.offsets.tolist(), []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    equal, own = _lines(raw[a:b])
                    again.append(equal)
                    names += own
                    words_in += own.values()
                    lists.append(len(names))
                chars = segment_sums(NOT_SPACE[s.data] & _NOT_CONTINUED[s.data], s.offsets)
                measures = (n_words, chars, segment_sums(_SYMBOL[s.data], s.offsets), np.array(again, np.int64), segment_sums(np.cumsum(mark[:-1]) > 0, bounds))
                for column, values in zip(out, measures, strict=True):
                    column.append(values)
            pairs = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            lines = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(words_in, pa.int64())], fields=list(_LINE))
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flat, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), lines)], [*batch.schema.names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, measure, f"{own}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines {LINES}")


def _documents(id_col: Column) -> Column:
    """Distinct ids, and rows without one each by itself."""
    return F.count_distinct(id_col) + F.count_if(id_col.isNull())


def boilerplate(measured: DataFrame, many_docs: int, min_docs: int, min_share: int) -> DataFrame:
    """(host, one, two, n_docs) of the lines above the limits.  A line stands once in a
    row's list, so rows bound documents from above: ids are told apart only for
    lines that enough rows hold."""
    lines = measured.select("host", "doc_id", F.explode("lines").alias("l")).select("host", "doc_id", "l.one", "l.two")
    line = ["host", "one", "two"]
    candidates = lines.groupBy(*line).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= min(many_docs, min_docs)).drop("n_rows")
    counts = lines.join(candidates, line).groupBy(*line).agg(_documents(F.col("doc_id")).alias("n_docs"))
    sizes = measured.groupBy("host").agg(_documents(F.col("doc_id")).alias("host_docs"))
    above = (F.col("n_docs") >= many_docs) | ((F.col("n_docs") >= min_docs) & (F.col("n_docs") * 100 >= F.col("host_docs") * min_share))
    return counts.join(sizes, "host").filter(above).select(*line, "n_docs")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", many_docs: int = MANY_DOCS, min_docs: int = MIN_DOCS, min_share: int = MIN_SHARE, min_left_share: int = MIN_LEFT_SHARE, min_left_words: int = MIN_LEFT_WORDS, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words and, with
    ``with_text``, cleaned (the text without boilerplate lines; null for a null
    text).

    Null and empty texts have no words and fail.  Null hosts are one host, the
    empty one.  Rows of one id are one document in the counts of lines and hosts,
    rows with a null id each one of its own; every row is judged by itself.  An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    measured = _measured(rows)
    measured = stored(measured if with_text else measured.drop("text"), "measured").select("*", row_number().alias("row"))
    frequent = stored(boilerplate(measured, many_docs, min_docs, min_share), "frequent-lines")
    held = measured.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.one", "l.two", "l.n").join(frequent, ["host", "one", "two"])
    removed = held.groupBy("row").agg(F.sum("n").alias("n_removed_words"), *([F.collect_list(F.struct("one", "two")).alias("bad")] if with_text else []))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0))
    left = F.col("n_words") - gone
    kept = ~failed & (100 * left >= min_left_share * F.col("n_words")) & (left >= min_left_words)
    measures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = measured.drop("lines").join(removed, "row", "left")
    out = out.select(*measures, failed.alias("base_failed"), kept.alias("kept"), gone.alias("n_removed_words"), *(["text", "bad"] if with_text else []))
    return _cleaned(out) if with_text else out


def _cleaned(rows: DataFrame) -> DataFrame:
    """``text`` and ``bad`` (digests of lines that go) become ``cleaned``."""

    def clean(batches):
        for batch in batches:
            texts = []
            for text, bad in zip(batch.column("text").to_pylist(), batch.column("bad").to_pylist(), strict=True):
                if text is not None and bad:
                    gone = {np.array([d["one"], d["two"]], "<i8").tobytes() for d in bad}
                    lines = text.encode().split(b"\n")
                    text = b"\n".join(x for x in lines if not (words := _normal(x)) or _digest(words) not in gone).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], [*batch.schema.names[:-2], "cleaned"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "bad"))
    return map_arrow(rows, clean, f"{own}, cleaned string")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(CAST(doc_id AS VARCHAR), 'row ' || row_number() OVER ()) AS document, coalesce(source, '') AS host, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, k, array_to_string(w[k : k + 4], ' ') AS phrase FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS k FROM base WHERE len(w) >= 5)
), repeats AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT rid, unnest(generate_series(k, k + 4)) AS j FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, phrase) AS n FROM windows) WHERE n > 1) GROUP BY rid
), lines AS (
  SELECT rid, document, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT rid, document, host, unnest(string_split(body, chr(10))) AS line FROM base)
), worded AS (
  SELECT rid, document, host, line, len(lw) AS n, array_to_string(lw, ' ') AS normal FROM lines WHERE len(lw) > 0
), dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY rid
), frequent AS (
  SELECT host, normal FROM (SELECT host, normal, count(DISTINCT document) AS n_docs FROM worded GROUP BY host, normal)
  JOIN (SELECT host, count(DISTINCT document) AS host_docs FROM base GROUP BY host) USING (host)
  WHERE n_docs >= 30 OR (n_docs >= 5 AND n_docs * 100 >= host_docs * 10)
), removed AS (
  SELECT rid, sum(n) AS n_removed FROM worded JOIN frequent USING (host, normal) GROUP BY rid
), judged AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed_words
  FROM base LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN removed USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - n_removed_words) >= 50 * n_words AND n_words - n_removed_words >= 10 AS kept, n_removed_words
FROM judged
"""
