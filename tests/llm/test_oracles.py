"""Every registered SQL text of this subpackage, run by DuckDB, against its query."""

import pytest

from tallyfold.llm.queries import ORACLES, QUERIES

from ..conftest import DATA, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck, ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
