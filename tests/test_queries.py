"""Every query against its SQL."""

import pytest

from lotledger import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 50
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_contacts_of_documents(spark, sf_dir):
    found = queries.QUERIES["contacts_of_documents"](spark, sf_dir)
    assert {r.kind for r in found.select("kind").distinct().collect()} <= {"email", "phone"}
