"""Every query beside its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__
from oracle_check import compare, connect
from tidewire.plans.oracle import SQL
from tidewire.plans.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
# Their thresholds select nothing on tables this small.
EMPTY_HERE = {"cooccur_person_org", "cooccur_org_loc"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(SQL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, name):
    result = compare(__spark_entry__.queries()[name](spark, FOLDER), con, __spark_entry__.oracle_sql()[name])
    assert result == ("no rows on either side" if name in EMPTY_HERE else "")


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["severity"] == "CRITICAL"
