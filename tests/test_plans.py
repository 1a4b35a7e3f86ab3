"""Plan checks: the core jobs stay JVM-side, partial-aggregate before the
shuffle, prune columns at the scan, and never funnel the table into one task."""

from equiloan.constants import ATTRIBUTES
from equiloan.operators import parity
from equiloan.plans import views

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contingency_plan_is_jvm_side_and_partial(spark):
    df = views.labelled(spark, SF_SMALL)
    ct = parity.contingency(df, ATTRIBUTES)
    plan = _plan(ct)
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "SinglePartition" not in plan
    phys = ct._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in phys or "partial_sum" in phys


def test_scan_prunes_columns(spark):
    df = views.labelled(spark, SF_SMALL)
    ct = parity.contingency(df, ATTRIBUTES)
    plan = ct._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans
    for line in scans:
        # the contingency needs six columns of the application table
        assert "derived_race" not in line and "denial_reason_1" not in line and "credit_score" not in line


def test_stand_in_scan_prunes_columns(spark):
    df = views.applications(spark, SF_SMALL, stored=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "lineitem" in line and "ReadSchema" in line:
            assert "l_shipdate" not in line and "l_tax" not in line


def test_flagship_has_no_single_partition_exchange(spark):
    import __spark_entry__ as E

    plan = _plan(E.entry(spark))
    assert "SinglePartition" not in plan
    assert "PythonUDF" not in plan
