"""Queries of the catalogue on small made tables, against their SQL."""

import duckdb
import pytest

from tarnwell.plans import catalogue

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def equal(spark, tmp_path):
    """Assert that a query on some documents gives what its SQL gives."""

    def check(name, docs):
        rows = [(n, text, "en", site, len(text or "")) for n, site, text in docs]
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        connection = duckdb.connect()
        connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        df, answer = catalogue.QUERIES[name](spark, str(tmp_path)), connection.sql(catalogue.SQL[name])
        at = [answer.columns.index(c) for c in df.columns]
        want = sorted(str(tuple(r[i] for i in at)) for r in answer.fetchall())
        assert sorted(str(tuple(r)) for r in df.collect()) == want
        return want

    return check


def test_relevance_at_a_decimal_half(equal):
    """40 of 103 is 0.38835, whose nearest double is below the half."""
    rows = equal("search_response_json", [(1, "src1", "the " * 103), (2, "src1", "the " * 40), (3, "src1", "zz")])
    assert "0.3883" in rows[0]
