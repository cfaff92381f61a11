"""Every registered query against its SQL, over whole tables."""

import check
import pytest

from propwell.queries import ORACLE, QUERIES

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = check.connect(SF_DIR)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert check.difference(frame, duck, ORACLE[name]) is None


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["source", "inserted", "skipped"]
    assert frame.count() > 0
