"""Every query with SQL gives the rows and columns of its SQL on DuckDB."""

import pytest
from oracle import connect, difference

from confab.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_repeats(spark, sf_dir, name):
    """What SQL cannot say runs over the whole table and gives the same rows again; other tests hold it against worked examples."""
    frame = QUERIES[name](spark, sf_dir)
    rows = sorted(map(repr, frame.collect()))
    assert rows == sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))
    assert rows or name in ("silence_insertions",)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
