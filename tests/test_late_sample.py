"""The review sample: size min(n, late), repeatable, independent of partitioning,
and only measured completion times."""

from __future__ import annotations

from gridsla.plans.analysis import SlaAnalysis
from gridsla.sources.events import load_inputs


def _sample(a, n, seed=0):
    return {(r.task, r.job_day, r.batch_guid, r.sla_order, r.job_id) for r in a.late_job_sample(n, seed).collect()}


def test_sample_size_and_repeatability(spark):
    jobs, alarms, imports = load_inputs(spark, "/root/testdata/sf0.01")
    a = SlaAnalysis(jobs, alarms, imports)
    late = a.late_jobs()
    counts = {(r.task, r.job_day, r.batch_guid, r.sla_order): r["count"]
              for r in late.groupBy("task", "job_day", "batch_guid", "sla_order").count().collect()}
    s = _sample(a, 5)
    got = {}
    for k in s:
        got[k[:4]] = got.get(k[:4], 0) + 1
    assert got == {k: min(5, v) for k, v in counts.items()}
    assert _sample(a, 5) == s
    # other partitioning of the input, same sample
    b = SlaAnalysis(jobs.repartition(7), alarms, imports)
    assert _sample(b, 5) == s
    assert _sample(a, 5, seed=1) != s


def test_sample_and_export_keep_measured_times(spark):
    jobs, alarms, imports = load_inputs(spark, "/root/testdata/sf0.001")
    a = SlaAnalysis(jobs, alarms, imports)
    measured = {r.job_id: r.completiondatetime for r in jobs.collect()}
    for r in a.late_job_sample(3).collect():
        assert r.completiondatetime == measured[r.job_id]
    exp = a.late_job_export().collect()
    assert exp and all(r.completiondatetime == measured[r.job_id] for r in exp)
    assert all(r.overdue_minutes > 0 for r in exp)
