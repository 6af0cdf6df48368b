"""Rows that every operator on documents must stand."""

LONG = "alpha beta gamma delta " * 60_000  # 1.4 MB, more than a slice
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and then some more words follow it here.", "en", "h1", 1),
    (2, None, None, None, None),
    (3, "", "en", "h1", 0),
    (4, "   \n\t\r\n ", "de", None, 5),
    (5, LONG, "en", "h2", 5),
    (6, "the QUICK brown fox jumps over the lazy dog and then some more words follow it here.", "en", "h1", 1),
    (7, "Ünïcödé 漢字 😀 don't  stop\u00a0now", None, "h2", 3),
    (8, "12345 !!! ---", "fr", "h2", 2),
    (None, "a row without an id", "en", "h1", 1),
    (9, "twice", "en", "h1", 1),
    (9, "twice", "en", "h1", 1),
]
NAMES = ["text", "host", "line", "lines", "key", "node", "component", "rank", "order", "batch", "file", "place", "size", "class", "one", "two", "a", "b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=None):
    """The documents with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    return df.withColumns({n: F.lit("clash") for n in NAMES if n != "text"})


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def twins(length=1024):
    """Two different words of equal length whose difference no polynomial with an
    odd base modulo 2^64 sees: the Thue-Morse word over a and b and its complement."""
    bits = [bin(k).count("1") % 2 for k in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
