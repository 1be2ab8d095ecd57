"""Every core query against its SQL on the smallest tables."""

import importlib
import os

import pytest
from compare import connection, rows_of_spark, rows_of_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = [importlib.import_module(f"sedimark.plans.{m}") for m in ("problems", "ranking", "readmodel", "evaluation", "graph", "lifecycle", "parts")]
QUERIES = {n: (f, m.oracle().get(n)) for m in MODULES for n, f in m.queries().items()}


@pytest.fixture(scope="module")
def sql():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    query, oracle = QUERIES[name]
    cols, rows = rows_of_spark(query(spark, FOLDER))
    assert len(set(cols)) == len(cols)
    if oracle is not None:
        assert (cols, rows) == rows_of_sql(sql, oracle)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
