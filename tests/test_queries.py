"""Every registered query against its reference SQL, over whole tables."""

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as contract
from tablewarden.plans.oracle import oracle_texts
from tablewarden.plans.registry import registered


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


OWN = sorted(registered())


def test_every_query_has_reference_sql():
    assert set(OWN) == set(oracle_texts())
    assert set(OWN) <= set(contract.queries())


@pytest.mark.parametrize("name", OWN)
def test_query_matches_reference_sql(spark, sf, duck, name):
    got = spark_rows(contract.queries()[name](spark, sf))
    assert got == duck_rows(duck, contract.oracle_sql()[name])


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["id", "email", "phone", "credit_card", "amount"]
    assert df.count() > 0
