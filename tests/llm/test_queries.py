"""Registered queries against their SQL, and the guard around the optional part."""

import check
import pytest
from cases import SF_DIR

import __spark_entry__ as contract
from propwell.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    connection = check.connect(SF_DIR)
    yield connection
    connection.close()


def test_all_are_registered():
    names = contract.queries()
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    assert check.difference(QUERIES[name](spark, SF_DIR), duck, ORACLE[name]) is None
