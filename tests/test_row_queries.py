"""Every row-wise query against its SQL."""

import pytest

from grainmill.plans.queries import QUERIES as BASE
from grainmill.plans.row_queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(compare, name):
    compare(QUERIES[name], SQL[name])


def test_names():
    assert set(SQL) == set(QUERIES) and not set(QUERIES) & set(BASE)
