"""Every query of the library's own operators against its SQL."""

import pytest
from oracle import compare, connect

from stratalens.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, data, name):
    compare(spark, con, name, QUERIES[name], ORACLES[name], data)
