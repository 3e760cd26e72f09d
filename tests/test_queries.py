"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def names():
    from repolumen.plans import QUERIES
    return list(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from repolumen.plans import ORACLE, QUERIES
    frame = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert difference(frame, con, ORACLE[name]) is None
    else:
        assert len(frame.collect()) > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract
    assert contract.entry(spark).count() == 20
    assert set(contract.oracle_sql()) <= set(contract.queries())
