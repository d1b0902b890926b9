"""Every query of the library runs, and gives what DuckDB gives where SQL can express it."""

import pytest
from oracle import assert_same, connect

from tracewright.plans import detection, queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        assert_same(frame, duck, queries.ORACLES[name])
    else:
        assert frame.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
