from decimal import Decimal

import pytest

from gridsla.sources.policy import DEFAULT_POLICY, Tier, TaskPolicy, policy_frame, validate


def test_policy_values():
    got = {(p.tc, p.task, p.uses_guid): [(t.order, t.label, t.limit_min, t.target) for t in p.tiers]
           for p in DEFAULT_POLICY}
    d = Decimal
    assert got == {
        ("TC-12", "Alert / Tamper", True): [(1, "30 Min SLA", 30, d("0.90")), (2, "60 Min SLA", 60, d("0.99")),
                                            (3, "6 Hour SLA", 360, d("0.999")), (4, "SLA Breach", None, None)],
        ("TC-18", "Instant,Load Survey,", True): [(1, "2 Hour SLA", 120, d("0.95")), (2, "4 Hour SLA", 240, d("1.00")),
                                                  (3, "SLA Breach", None, None)],
        ("TC-10", "serviceFirmwareUpdate", False): [(1, "8 Hour SLA", 480, d("0.99")),
                                                    (2, "24 Hour SLA", 1440, d("0.999")),
                                                    (3, "SLA Breach", None, None)],
        ("TC-11", "serviceSetLoadLimit", True): [(1, "18 Hour SLA", 1080, d("0.99")),
                                                 (2, "24 Hour SLA", 1440, d("0.999")),
                                                 (3, "SLA Breach", None, None)],
    }


def test_breach_window_takes_last_limit():
    assert {p.task: p.window_limit(p.breach) for p in DEFAULT_POLICY} == {
        "Alert / Tamper": 360, "Instant,Load Survey,": 240,
        "serviceFirmwareUpdate": 1440, "serviceSetLoadLimit": 1440}


def test_policy_frame(spark):
    rows = policy_frame(spark).collect()
    assert len(rows) == 13
    breach = [r for r in rows if r.tier == "SLA Breach"]
    assert all(r.limit_min is None and r.target is None for r in breach)


def test_code_selects_its_task(make_jobs):
    import datetime as dt

    from gridsla import SlaAnalysis
    at = dt.datetime(2024, 3, 5, 10)
    jobs = make_jobs([(k, p.task, "g", "1", "M", at, at) for k, p in enumerate(DEFAULT_POLICY)])
    for p in DEFAULT_POLICY:
        rows = SlaAnalysis(jobs, tc=p.tc).batch_anchor().collect()
        assert [r.task for r in rows] == [p.task]
    with pytest.raises(ValueError):
        SlaAnalysis(jobs, tc="nosuch")
    with pytest.raises(ValueError):
        SlaAnalysis(jobs, tc=DEFAULT_POLICY[0].tc, task=DEFAULT_POLICY[1].task)


def test_validate_rejects_unsorted_limits():
    bad = (TaskPolicy("X", "x", True, (Tier(1, "a", 60, Decimal("0.9")), Tier(2, "b", 30, Decimal("0.9")),
                                        Tier(3, "SLA Breach", None, None))),)
    with pytest.raises(ValueError):
        validate(bad)


def test_cluster_settings_scale_with_input():
    from gridsla.plans.session import cluster_settings
    small = cluster_settings(10 << 30, executor_cores=4, executors=10)
    big = cluster_settings(100 << 40, executor_cores=4, executors=1000)
    assert int(small["spark.sql.shuffle.partitions"]) == 80          # two waves over 40 cores
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
