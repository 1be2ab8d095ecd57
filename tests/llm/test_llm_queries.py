"""Every text query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connection, rows_of_spark, rows_of_sql  # noqa: E402

from sedimark.llm import queries  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sql, name):
    cols, rows = rows_of_spark(queries.queries()[name](spark, FOLDER))
    assert max(rows.values(), default=1) == 1 or not name.endswith("_found")
    if name in queries.oracle():
        assert (cols, rows) == rows_of_sql(sql, queries.oracle()[name])
