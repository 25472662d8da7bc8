from __future__ import annotations

import pytest
from oracle import connect, same

from wayfold.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, sf_dir, name):
    same(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
