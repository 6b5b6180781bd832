"""Every registered query against its SQL, on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry
from shelfmark.queries import registered

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, duck, name):
    ok, note = check.compare(spark, duck, SF_DIR, name)
    assert ok, note


def test_queries_without_sql_are_few():
    assert set(registered()) - set(entry.oracle_sql()) == {"diff_unified"}
