"""Queries that SQL expresses, over the small tables."""

import pytest

from opsledger.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(agrees, name):
    agrees(queries.queries()[name], queries.oracle_sql()[name])
