"""Every registered query against its SQL; those without SQL run and give rows."""

import pytest

from longview.registry import QUERIES, SQL
from tests.harness import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    rows = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare(rows, con, SQL[name]) == ""
    else:
        assert rows.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
