"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import ROOT, compare, oracle

from terrakit.registry import all_queries

QUERIES = all_queries()
SF = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    status, rows, _, note = compare(spark, duck, QUERIES[name], SF)
    assert status in ("ok", "rows", "EMPTY"), f"{status} {note}"


def test_entry_has_rows(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 4
    assert set(oracle_sql()) <= set(queries())
