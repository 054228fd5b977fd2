"""All queries with SQL against DuckDB,."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import rows_of, rows_of_sql

from loomlog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 200
