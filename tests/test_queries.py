"""Every registered query against its SQL, on the smallest test tables."""

import pytest

import __spark_entry__ as contract
from tallyhouse.plans.all import QUERIES

from . import oracle


@pytest.fixture(scope="module")
def db(data_dir):
    return oracle.connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, data_dir, name):
    oracle.compare(contract.queries()[name](spark, data_dir), db, contract.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


def test_entry_gives_rows(spark):
    flagship = contract.entry(spark)
    assert flagship.columns == ["product_id", "name", "sale_count", "refund_count", "gross", "refund_amount"]
    assert flagship.count() > 0


def test_compare_notices_a_difference(spark, db):
    with pytest.raises(AssertionError):
        oracle.compare(spark.sql("SELECT 1.5D AS a"), db, "SELECT 1.6::DOUBLE AS a")
