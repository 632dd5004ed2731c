"""Every geometry query against its SQL on the smallest tables."""

import pytest

from fusionframe import queries as q

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, data, duck, name):
    assert same_rows(q.queries()[name](spark, data), duck, q.oracle_sql()[name])


@pytest.mark.parametrize("name", ["asof_unique", "triplet_mining"])
def test_runs(spark, data, name):
    assert q.queries()[name](spark, data).columns
