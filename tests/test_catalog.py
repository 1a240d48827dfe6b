"""Every registered query against its SQL, on the smallest tables."""

import pytest

from logloom import catalog
from tests.conftest import oracle, rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert name in catalog.ORACLES
    assert rows(catalog.QUERIES[name](spark, sf_dir).toPandas()) == rows(oracle(catalog.ORACLES[name], sf_dir))
