"""Every named query runs; where SQL can say it, both sides give the same bag of rows."""

import re

import pytest

import __spark_entry__ as entry_module
from oracle import check, connect

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(set(SQL)))
def test_equals_sql(spark, con, small_dir, name):
    rows, problem = check(spark, con, name, QUERIES[name], SQL[name], small_dir)
    assert not problem, problem


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows_and_a_stable_schema(spark):
    a, b = entry_module.entry(spark), entry_module.entry(spark)
    assert a.schema == b.schema
    assert a.count() > 0


def test_every_survey_operator_has_a_query():
    ids = {re.match(r"([a-j]\d+)_", q).group(1) for q in QUERIES if re.match(r"[a-j]\d+_", q)}
    wanted = ([f"a{i}" for i in range(1, 12)] + [f"b{i}" for i in range(1, 21)]
              + [f"c{i}" for i in range(1, 9)] + [f"d{i}" for i in range(1, 4)]
              + [f"e{i}" for i in range(1, 6)] + [f"f{i}" for i in range(1, 18)]
              + [f"g{i}" for i in range(1, 24)] + [f"h{i}" for i in range(1, 21)]
              + [f"i{i}" for i in range(1, 16)] + [f"j{i}" for i in range(1, 12)])
    assert sorted(set(wanted) - ids) == []
