"""Every registered query against its SQL on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from turnwise import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    status, n, _, note = compare(spark, con, name, plans.QUERIES[name], plans.ORACLES.get(name), SF)
    assert status == "ok", note or "no rows"


def test_every_query_has_sql():
    assert set(plans.ORACLES) == set(plans.QUERIES)


def test_flagship_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
