"""Every registered query against its SQL on the smallest tables."""

import pytest

from prefixlake.queries import ORACLES, QUERIES
from tests.oracle_check import compare

SF_DIR = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    problem, _ = compare(spark, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert problem == ""


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
