from __future__ import annotations

import pytest
from support import SF

import __spark_entry__ as contract
import check
from tallyhour.plans import oracle
from tallyhour.plans import queries as registry
from tallyhour.schemas import EVENTS_WRITTEN


@pytest.fixture(scope="module")
def db():
    return check.database(SF)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_agrees_with_its_sql(spark, db, name):
    n_rows, difference = check.compare(spark, db, SF, name)
    assert not difference
    assert n_rows > 0


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == EVENTS_WRITTEN
    assert rows.count() > 0
