"""The report from one scan of the job log, and from a kept histogram that days are folded into."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridsla.operators import sla as S
from gridsla.operators.histogram import ReportState, batch_histogram, histogram_counts, merge_histograms
from gridsla.plans import analysis
from gridsla.plans.analysis import SlaAnalysis
from gridsla.sources.events import load_inputs

REPORT = ("batch_anchor", "sla_gap", "late_summary", "tier_window", "unknown_task_report")


def report(a: SlaAnalysis) -> dict:
    out = {n: sorted(map(repr, getattr(a, n)(**({"with_time": False} if n == "unknown_task_report" else {})).collect()))
           for n in REPORT}
    out["sla_report"] = list(map(repr, a.sla_report(with_unknown=False).collect()))
    return out


@pytest.fixture(scope="module")
def jobs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "jobs")
    load_inputs(spark, "/root/testdata/sf0.001")[0].write.parquet(path)
    return spark.read.parquet(path)


def test_the_report_scans_the_job_log_once(jobs, monkeypatch):
    written = []
    monkeypatch.setattr(analysis, "materialize", lambda df, keep=analysis.materialize: written.append(df) or keep(df))
    a = SlaAnalysis(jobs)
    frames = [a.sla_report(), a.sla_gap(), a.late_summary(), a.batch_anchor(), a.tier_window()]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*written, *frames)]
    scans = sum(p.count("createddate#") > 0 and p.count("/log") for p in plans)
    assert scans == 1
    log_reads = [p for p in plans if "completiondatetime" in p and "FileScan" in p and "createddate" in p]
    assert len(log_reads) == 1 and "meterid" not in log_reads[0]


def test_counts_equal_those_of_the_timed_jobs(jobs):
    a = SlaAnalysis(jobs)
    got = histogram_counts(batch_histogram(jobs), a.anchors).collect()
    want = S.tier_counts(a.timed).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_limits_are_met_to_the_microsecond(make_jobs):
    at, us = dt.datetime(2024, 3, 5, 10, 0, 0, 999_999), dt.timedelta(microseconds=1)
    limit = at.replace(microsecond=0) + dt.timedelta(minutes=30)
    ends = [limit, limit - us, limit + us, limit + dt.timedelta(seconds=1), None]
    a = SlaAnalysis(make_jobs([(k, "Alert / Tamper", "g", "1", "M", at, e) for k, e in enumerate(ends)]))
    assert [(r.metric, r.completed_count, r.unfinished_count) for r in a.sla_report().collect()] == [
        ("30 Min SLA", 2, 1), ("60 Min SLA", 4, 1), ("6 Hour SLA", 4, 1), ("SLA Breach", 0, 1)]


def test_folding_days_equals_a_full_run(spark, jobs, tmp_path):
    state = ReportState(spark, str(tmp_path / "state"))
    assert report(SlaAnalysis(None, histogram=state.histogram()))["sla_report"] == []
    days = [r[0] for r in jobs.select(F.to_date("createddate").alias("d")).distinct().orderBy("d").collect()]
    late = F.xxhash64("job_id") % 7 == 0
    for day in days[:5]:  # days one by one, without some rows
        assert state.fold(jobs.filter((F.to_date("createddate") == F.lit(day)) & ~late)) == [day]
    state.fold(jobs.filter((F.to_date("createddate") > F.lit(days[4])) & ~late))
    touched = state.fold(jobs.filter(late & (F.to_date("createddate") < F.lit(days[20]))))  # late rows of many days
    assert 1 < len(touched) <= 20
    assert state.replace(jobs.filter(F.to_date("createddate") >= F.lit(days[20]))) == days[20:]  # whole days again
    state.replace(jobs.filter(F.to_date("createddate") == F.lit(days[3])))  # the same once more changes nothing
    assert state.fold(jobs.limit(0)) == []
    got = report(SlaAnalysis(None, histogram=state.histogram()))
    assert got == report(SlaAnalysis(jobs))
    kept = {tuple(r) for r in state.histogram().collect()}
    assert kept == {tuple(r) for r in batch_histogram(jobs).collect()}
    some = state.histogram(days[2:4])
    assert f"PartitionFilters: [state_day" in some._jdf.queryExecution().executedPlan().toString()
    one = report(SlaAnalysis(None, histogram=state.histogram(), day=days[2], task="serviceSetLoadLimit", guid="G1"))
    want = report(SlaAnalysis(jobs, day=days[2], task="serviceSetLoadLimit", guid="G1"))
    assert one == want and one["sla_report"]


def test_parts_merge_in_any_order(jobs):
    parts = [batch_histogram(jobs.filter(F.xxhash64("job_id") % 3 == k)) for k in (0, -1, 1, -2, 2)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merge_histograms(p.unionByName(merged))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, batch_histogram(jobs).collect()))
