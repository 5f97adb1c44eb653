"""Hand-made rows for the report's edge cases (FIXTURES §4, SURVEY §2.11)."""

from __future__ import annotations

from gridsla.plans.analysis import SlaAnalysis
from gridsla.sources.policy import BREACH

from .conftest import ts

AT = "Alert / Tamper"
FW = "serviceFirmwareUpdate"


def report(jobs, **kw):
    rows = SlaAnalysis(jobs, **kw).sla_report().collect()
    return {(r.task, r.batch_guid, r.metric): r for r in rows}


def test_null_completion_counts_in_total_only(make_jobs):
    jobs = make_jobs([
        (1, AT, "g", "1", "M1", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:10:00")),
        (2, AT, "g", "1", "M2", ts("2024-01-01 10:00:00"), None),
    ])
    r = report(jobs)
    assert r[(AT, "g", "30 Min SLA")].total_jobs == 2
    assert r[(AT, "g", "30 Min SLA")].completed_count == 1
    assert r[(AT, "g", BREACH)].completed_count == 0  # NULL is not a breach in the report
    assert r[(AT, "g", BREACH)].unfinished_count == 1
    a = SlaAnalysis(jobs)
    tiers = {x.job_id: x.sla_tier for x in a.tier_of_job().collect()}
    assert tiers[2] == BREACH  # ... but the CASE labels it breach
    assert a.late_jobs().filter("job_id = 2").count() == 0  # and it is late for no tier


def test_completion_exactly_on_limit_is_inside(make_jobs):
    jobs = make_jobs([
        (1, AT, "g", "1", "M1", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:30:00")),
        (2, AT, "g", "1", "M2", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:30:00.000001")),
    ])
    r = report(jobs)
    assert r[(AT, "g", "30 Min SLA")].completed_count == 1
    assert r[(AT, "g", "60 Min SLA")].completed_count == 2


def test_anchor_truncated_to_second_and_shared(make_jobs):
    jobs = make_jobs([
        (1, AT, "g", "1", "M1", ts("2024-01-01 10:00:00.999"), ts("2024-01-01 10:30:00.500")),
        (2, AT, "g", "1", "M2", ts("2024-01-01 10:20:00"), ts("2024-01-01 10:31:00")),
    ])
    a = SlaAnalysis(jobs)
    anchor = a.batch_anchor().collect()
    assert anchor[0].job_date == ts("2024-01-01 10:00:00")
    assert anchor[0].total_jobs == 2
    r = report(jobs)
    # 10:30:00.5 is past 10:00:00 + 30 min; job 2 also measured from the batch anchor
    assert r[(AT, "g", "30 Min SLA")].completed_count == 0
    assert r[(AT, "g", "60 Min SLA")].completed_count == 2


def test_absent_batch_gives_no_rows(make_jobs):
    jobs = make_jobs([(1, AT, "g", "1", "M1", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:10:00"))])
    assert SlaAnalysis(jobs, guid="other").sla_report().count() == 0
    assert not SlaAnalysis(jobs, guid="other").has_batches()
    assert SlaAnalysis(jobs, guid="g").has_batches()
    assert SlaAnalysis(jobs, day="2024-01-02").sla_report().count() == 0


def test_percentage_half_up(make_jobs, spark):
    from pyspark.sql import functions as F

    from gridsla.functions.metrics import percentage
    df = spark.createDataFrame([(29, 20000), (1, 3), (2, 3), (1162, 20001), (0, 7), (5, 0)], "n long, t long")
    got = [r.p for r in df.select(percentage(F.col("n"), F.col("t")).alias("p")).collect()]
    assert got == [0.15, 33.33, 66.67, 5.81, 0.0, None]


def test_pending_and_breach_pending(make_jobs):
    # 10 jobs: 8 within 30 min, 1 within 60 min, 1 breach -> targets 9 / 10 / 10
    rows = [(i, AT, "g", "1", f"M{i}", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:05:00")) for i in range(8)]
    rows.append((8, AT, "g", "1", "M8", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:45:00")))
    rows.append((9, AT, "g", "1", "M9", ts("2024-01-01 10:00:00"), ts("2024-01-01 17:00:00")))
    r = report(make_jobs(rows))
    assert r[(AT, "g", "30 Min SLA")].pending_for_target == 1   # ceil(10*0.90)=9 - 8
    assert r[(AT, "g", "60 Min SLA")].pending_for_target == 1   # ceil(10*0.99)=10 - 9
    assert r[(AT, "g", "6 Hour SLA")].pending_for_target == 1   # ceil(10*0.999)=10 - 9
    assert r[(AT, "g", BREACH)].completed_count == 1
    assert r[(AT, "g", BREACH)].pending_for_target == 0         # max(1 - 1, 0)
    assert r[(AT, "g", "30 Min SLA")].percentage == 80.0


def test_late_sets_nest_and_distinct_count(make_jobs):
    jobs = make_jobs([(1, AT, "g", "1", "M1", ts("2024-01-01 10:00:00"), ts("2024-01-01 18:00:00"))])
    a = SlaAnalysis(jobs)
    late = a.late_jobs().collect()
    assert sorted(r.sla_tier for r in late) == sorted(["30 Min SLA", "60 Min SLA", "6 Hour SLA"])
    assert {r.completiondatetime for r in late} == {ts("2024-01-01 18:00:00")}
    summary = {r.metric: r.value for r in a.late_summary().collect()}
    assert summary["distinct late jobs"] == 1
    assert summary["30 Min SLA late jobs"] == 1 and summary["6 Hour SLA late jobs"] == 1


def test_oldest_open_guid_tie_goes_to_smaller_guid(make_jobs):
    jobs = make_jobs([
        (1, AT, "b", "1", "M1", ts("2024-01-01 09:00:00"), None),
        (2, AT, "a", "1", "M2", ts("2024-01-01 09:00:00"), None),
        (3, AT, "0", "0", "M3", ts("2024-01-01 08:00:00"), None),  # closed: ignored
    ])
    rows = SlaAnalysis(jobs).oldest_open_guid().collect()
    assert [(r.guid, r.first_open_createddate) for r in rows] == [("a", ts("2024-01-01 09:00:00"))]


def test_firmware_ignores_guid(make_jobs):
    jobs = make_jobs([
        (1, FW, "x", "1", "M1", ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00")),
        (2, FW, "y", "1", "M2", ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00")),
        (3, FW, None, "1", "M3", ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00")),
    ])
    anchors = SlaAnalysis(jobs, guid="x").batch_anchor().collect()
    assert [(r.batch_guid, r.total_jobs) for r in anchors] == [("ALL", 3)]


def test_guid_task_without_guid_is_in_no_batch(make_jobs):
    jobs = make_jobs([(1, AT, None, "1", "M1", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:10:00"))])
    assert SlaAnalysis(jobs).batch_anchor().count() == 0


def test_unknown_task_gives_one_na_row(make_jobs):
    jobs = make_jobs([
        (1, "somethingElse", "g", "1", "M1", ts("2024-01-01 10:00:00"), ts("2024-01-01 10:10:00")),
        (2, "somethingElse", "h", "1", "M2", ts("2024-01-01 11:00:00"), None),
    ])
    rows = SlaAnalysis(jobs).sla_report().collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.metric, r.total_jobs, r.completed_count, r.percentage, r.pending_for_target, r.sla_order) == \
        ("N/A", 0, 0, 0.0, 0, 1)
    assert r.job_date is not None


def test_invariants_on_fixture(spark):
    from gridsla.sources.events import load_inputs
    jobs, alarms, imports = load_inputs(spark, "/root/testdata/sf0.001")
    a = SlaAnalysis(jobs, alarms, imports)
    # exclusive tiers sum to the total
    per_batch = {(r.task, r.job_day, r.batch_guid): r.total_jobs for r in a.batch_anchor().collect()}
    excl = {}
    for r in a.tier_of_job().groupBy("task", "job_day", "batch_guid").count().collect():
        excl[(r.task, r.job_day, r.batch_guid)] = r["count"]
    assert excl == per_batch
    # completed + breach + unfinished == total on the last tier
    rep = a.sla_report(with_unknown=False).collect()
    by_batch = {}
    for r in rep:
        by_batch.setdefault((r.task, r.job_day, r.batch_guid), []).append(r)
    for rows in by_batch.values():
        rows.sort(key=lambda r: r.sla_order)
        assert rows[-2].completed_count + rows[-1].completed_count + rows[-1].unfinished_count == rows[0].total_jobs
        cum = [r.completed_count for r in rows[:-1]]
        assert cum == sorted(cum)
    # powered off + eligible == meters of the tier
    s = {(r.task, r.job_day, r.batch_guid, r.sla_tier): r for r in a.power_summary().collect()}
    m = {}
    for r in a.meters_by_tier().groupBy("task", "job_day", "batch_guid", "sla_tier").count().collect():
        m[(r.task, r.job_day, r.batch_guid, r.sla_tier)] = r["count"]
    assert {k: v.total_meters for k, v in s.items()} == m
    assert all(v.power_off_meters + v.after_removing_power_off == v.total_meters for v in s.values())
