"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sievetext.plans.queries import REGISTRY
from tools.check_oracles import compare, duck


@pytest.fixture(scope="module")
def con(small) -> duckdb.DuckDBPyConnection:
    return duck(small)


def test_every_query_has_a_twin():
    assert set(REGISTRY) <= set(entry.queries()) and set(REGISTRY) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, con, small, name):
    same, text = compare(spark, con, small, name)
    assert same, text


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "ord", "category", "dist", "score"] and rows.count() > 0
