"""Every query of the catalogue against its SQL, and the driver's entry points."""

import pytest

from opsledger.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_agrees_with_sql(agrees, name):
    agrees(catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["tag", "avg_ms", "min_ms", "max_ms", "n"]
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_filters_and_columns_reach_the_scan(spark):
    from tests.conftest import SMALL

    plan = catalogue.queries()["error_log_tail"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = catalogue.queries()["check_summary"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "toxic" not in plan
