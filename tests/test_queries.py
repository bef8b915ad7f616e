"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from datumgate.plans.oracles import all_oracles
from datumgate.plans.queries import all_queries

from .compare import connect, difference

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf_check):
    return connect(sf_check)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"profile_approx_distinct"}


def test_the_driver_sees_them_all():
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 11


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_check, name):
    assert difference(QUERIES[name](spark, sf_check), con, ORACLES[name]) is None


def test_approximate_distinct_is_close(spark, sf_check):
    approx = {r.column: r.distinct_count_approx for r in QUERIES["profile_approx_distinct"](spark, sf_check).collect()}
    exact = {r.column: r.distinct_count for r in QUERIES["profile_exact_distinct"](spark, sf_check).collect()}
    for column, count in exact.items():
        assert abs(approx[column] - count) <= max(2, 0.08 * count), column
