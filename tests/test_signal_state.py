"""Signal slots kept by day and bucketed by (meter, day): folding, re-sent days, and plans without a shuffle of slots."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridsla.operators import power as P
from gridsla.operators.signal_state import SignalState
from gridsla.plans.analysis import SlaAnalysis
from gridsla.sources.events import load_inputs
from tests.test_signals import ancestors

OUTPUTS = ("meter_power_state", "power_status_before", "prior_power_code", "flip_counts", "latest_flip", "import_presence",
           "power_summary", "late_job_export")


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    out, folder = [], tmp_path_factory.mktemp("log")
    for name, df in zip(("jobs", "alarms", "imports"), load_inputs(spark, "/root/testdata/sf0.001")):
        df.write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


@pytest.fixture(scope="module")
def state(spark, logs, tmp_path_factory):
    s = SignalState(spark, str(tmp_path_factory.mktemp("kept") / "sig'nals"), buckets=4)
    s.fold(*logs[1:])
    return s


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_outputs_equal_those_of_the_logs(logs, state):
    full, kept = SlaAnalysis(*logs), SlaAnalysis(logs[0], signals=state)
    for name in OUTPUTS:
        got = rows(getattr(kept, name)())
        assert got and got == rows(getattr(full, name)()), name
    with pytest.raises(ValueError, match="alarm log"):
        kept.power_flips()
    for a in (full, kept):
        a.close()


def test_folding_parts_equals_one_fold(spark, logs, state, tmp_path):
    alarms, imports = logs[1:]
    parts = SignalState(spark, str(tmp_path / "s"), buckets=4)
    assert parts.fold(alarms.limit(0), None) == [] and parts.slots().count() == 0
    days = [r[0] for r in alarms.select(F.to_date("alarm_date").alias("d")).distinct().orderBy("d").collect()]
    late = F.xxhash64("meterid") % 3 == 0
    assert parts.fold(alarms.filter((F.to_date("alarm_date") == F.lit(days[2])) & late), None) == [days[2]]
    parts.fold(alarms.filter(~late), None)
    parts.fold(alarms.filter(late & (F.to_date("alarm_date") != F.lit(days[2]))), imports)
    assert rows(parts.slots()) == rows(state.slots())
    some = alarms.filter(F.to_date("alarm_date") == F.lit(days[5])), imports.filter(F.to_date("das_rtc") == F.lit(days[5]))
    parts.fold(*some)  # by mistake a second time
    assert rows(parts.slots()) != rows(state.slots())
    assert parts.replace(*some) == [days[5]]
    assert rows(parts.slots()) == rows(state.slots())
    again = SignalState(spark, str(tmp_path / "s"))  # as another session opens it
    spark.sql(f"DROP TABLE {parts.table}")
    again = SignalState(spark, str(tmp_path / "s"))
    assert again.buckets == 4 and rows(again.slots()) == rows(state.slots())
    with pytest.raises(ValueError, match="4 buckets"):
        SignalState(spark, str(tmp_path / "s"), buckets=8)


def test_alarm_days_equal_those_of_the_log(logs, state):
    before = dt.date(2024, 1, 20)
    assert rows(state.alarm_days()) == rows(P.alarm_daily_summary(logs[1].filter(F.col("meterid").isNotNull())))
    plan = state.alarm_days(before)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(state_day" in plan


def test_slots_are_not_shuffled(logs, state):
    """From the scan of the slots up to the window over (meter, day) there is no exchange; the bounds have one."""
    one = SlaAnalysis(*logs).anchors.filter("task = 'serviceSetLoadLimit'").orderBy("job_day", "batch_guid").first()
    for narrow in ({}, {"task": one.task, "day": str(one.job_day.date()), "guid": one.batch_guid}):
        a = SlaAnalysis(logs[0], signals=state, **narrow)
        states = a.meter_power_state()
        states.collect()
        plan = states._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        paths = ancestors(plan, r"FileScan parquet .*n_imports.*Bucketed: true")
        assert paths, plan
        for path in paths:
            window = next(i for i, x in enumerate(path) if "Window" in x)
            assert not any("Exchange" in x for x in path[:window]), plan
            assert any("Union" in x for x in path[:window])
        assert "PartitionFilters: [isnotnull(state_day" in plan
        a.close()


def test_a_hot_meter_keeps_its_slots_only(spark, make_alarms, make_imports, tmp_path):
    day = dt.datetime(2024, 6, 1)
    signals = spark.range(30_000).select(
        F.lit("HOT").alias("meterid"),
        F.timestamp_add("MILLISECOND", F.col("id") % 20_000 * 9_000, F.lit(str(day)).cast("timestamp_ntz")).alias("alarm_date"),
        F.lit("METER_LAST_GASP").alias("alarm_names"))
    state = SignalState(spark, str(tmp_path / "s"), buckets=4)
    assert len(state.fold(signals, None)) == 3  # 20,000 times 9 seconds
    assert state.slots().count() == 20_000
    assert state.slots().agg(F.sum("n_alarms")).first()[0] == 30_000
    nothing = make_alarms([(None, day, "METER_LAST_GASP"), ("A", None, "METER_LAST_GASP")]), make_imports([("A", None), (None, day)])
    assert state.fold(*nothing) == [] and state.slots().count() == 20_000
