"""Queries of the corpus operators against their SQL on DuckDB."""

import pytest
from oracle import connect, difference

from confab.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None
