"""Queries against their SQL, and both sides' completeness."""

import pytest

from tarnwell.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.SQL[name])


def test_entry_has_all_queries():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in __spark_entry__.queries()}
    assert "pipeline" in __spark_entry__.queries()
