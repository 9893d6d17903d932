"""Spark result == DuckDB oracle for every registered query that SQL can express."""

import pytest

from tools.oracle_check import check

from oracle.queries import SQL

KEYS = sorted(SQL)


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, key):
    res = check(spark, "/root/testdata/sf0.001", [key], verbose=False)
    assert res[key][0] == "OK", res[key]


def test_every_key_has_an_entry():
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 88
