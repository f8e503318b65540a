"""Plans that would not survive at scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
# the plans of fitted models are those of their features, which feat_ and an_ queries have
NAMES = sorted(n for n in entry.queries() if not n.startswith("ml_"))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_no_product_and_no_row_at_a_time_python(spark, name):
    plan = entry.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["scan_project_filter"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "In(l_returnflag" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]
