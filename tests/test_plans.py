"""Plan shapes that matter at scale, checked on the physical plans of every registered query."""

from __future__ import annotations

import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_quadratic_joins_or_sort_aggregates(spark):
    for name, fn in ((n, E.queries()[n]) for n in E.QUERY_NAMES):
        plan = _plan(fn(spark, SF))
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "CartesianProduct" not in plan, name
        if name != "oldest_open_guid":  # its string min runs on the tie rows only
            assert "SortAggregate" not in plan, name


def test_sample_limits_before_the_shuffle(spark):
    plan = _plan(E.queries()["late_job_sample"](spark, SF))
    # one WindowGroupLimit below the exchange (partial), one above (final)
    assert len(re.findall("WindowGroupLimit", plan)) == 2


def test_report_scan_is_pruned(spark):
    plan = _plan(E.queries()["sla_report"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("props" not in s and "event_type" not in s for s in schemas)


def test_one_day_run_pushes_time_ranges_to_signal_scans(spark):
    from gridsla.plans.analysis import SlaAnalysis
    from gridsla.sources.events import load_inputs
    jobs, alarms, imports = load_inputs(spark, SF)
    plan = _plan(SlaAnalysis(jobs, alarms, imports, day="2024-01-05").meter_power_state())
    pushed = re.findall(r"PushedFilters: (.{0,200})", plan)
    assert any("GreaterThanOrEqual(ts" in p for p in pushed)
    assert any("LessThan(ts" in p for p in pushed)
