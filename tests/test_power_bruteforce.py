"""Power state against a brute-force reading of the rules, on seeded random alarms.

Many meters share one batch, each with its own random alarms and imports around
the tier windows (before the start on earlier days and the same day, exactly on
the boundaries, inside, after, and across midnight), so one Spark run checks
many combinations.
"""

from __future__ import annotations

import datetime as dt
import random
import re

from gridsla.functions import power as PW
from gridsla.plans.analysis import SlaAnalysis

AT = "Alert / Tamper"
FW = "serviceFirmwareUpdate"
NAMES = ["METER_FIRST_BREATH", "METER_LAST_GASP", "COVER_OPEN", "METER_LAST_GASP,METER_FIRST_BREATH"]


def expected_state(alarms, imports, start, end):
    before = [(t, n) for t, n in alarms if t < start]
    on = [t for t, n in before if "METER_FIRST_BREATH" in n]
    off = [t for t, n in before if "METER_LAST_GASP" in n]
    if not before:
        code = None
    else:
        last_on, last_off = max(on, default=None), max(off, default=None)
        code = 1 if (last_on is not None and last_off is not None and last_on > last_off) else 0
    flips = [(t, n) for t, n in alarms if start <= t <= end
             and ("METER_FIRST_BREATH" in n or "METER_LAST_GASP" in n)]
    imported = any(start <= t <= end for t in imports)
    if flips:
        return PW.STATE_INTERMITTENT
    if imported and code == 1:
        return PW.STATE_ON
    if imported and code == 0:
        return PW.STATE_ON_MISSED_BREATH
    if not imported and code == 0:
        return PW.STATE_OFF
    if not imported and code == 1:
        return PW.STATE_OFF_MISSED_GASP
    return PW.STATE_OTHER


def test_random_meters(make_jobs, make_alarms, make_imports):
    rng = random.Random(7)
    batches = {AT: (dt.datetime(2024, 3, 5, 10, 0, 0), 30), FW: (dt.datetime(2024, 3, 5, 22, 30, 0), 480)}
    jobs, alarms, imports, expect = [], [], [], {}
    for i in range(240):
        task = AT if i % 2 == 0 else FW
        start, limit = batches[task]
        end = start + dt.timedelta(minutes=limit)
        meter = f"R{i}"
        jobs.append((i, task, "g", "1", meter, start + dt.timedelta(milliseconds=300),
                     start + dt.timedelta(minutes=limit // 2)))
        points = [start, end, start - dt.timedelta(microseconds=1), end + dt.timedelta(microseconds=1)]
        mine_a, mine_i = [], []
        for _ in range(rng.randint(0, 5)):
            t = rng.choice([rng.choice(points),
                            start + dt.timedelta(minutes=rng.uniform(-3 * 1440, 2 * limit))])
            mine_a.append((t, rng.choice(NAMES)))
        for _ in range(rng.randint(0, 2)):
            mine_i.append(rng.choice([rng.choice(points), start + dt.timedelta(minutes=rng.uniform(-60, 2 * limit))]))
        alarms += [(meter, t, n) for t, n in mine_a]
        imports += [(meter, t) for t in mine_i]
        expect[meter] = expected_state(mine_a, mine_i, start, end)
    a = SlaAnalysis(make_jobs(jobs), make_alarms(alarms), make_imports(imports))
    got = {r.meterid: r.meter_power_state for r in a.meter_power_state().collect()}
    assert got == expect
    assert len(set(expect.values())) == 6  # every state is reached


def test_csv_sinks(spark, make_jobs, make_alarms, make_imports, tmp_path):
    from gridsla.sources.sinks import write_csv
    start = dt.datetime(2024, 3, 5, 10, 0, 0)
    jobs = make_jobs([(1, AT, "g", "1", "M1", start, start + dt.timedelta(hours=7)),
                      (2, AT, "g", "1", "M2", start, start + dt.timedelta(minutes=5))])
    alarms = make_alarms([("M1", start - dt.timedelta(days=1), "METER_LAST_GASP")])
    imports = make_imports([])
    a = SlaAnalysis(jobs, alarms, imports)
    write_csv(a.powered_off_list(), str(tmp_path / "off"))
    back = spark.read.option("header", True).csv(str(tmp_path / "off")).collect()
    assert [(r.meterid, r.sla_tier, r.status) for r in back] == [("M1", "SLA Breach", "Powered Off")]
    write_csv(a.late_job_export(), str(tmp_path / "late"))
    late = spark.read.option("header", True).csv(str(tmp_path / "late")).collect()
    assert sorted(r.missed_tier for r in late) == sorted(["30 Min SLA", "60 Min SLA", "6 Hour SLA"])


def test_write_outputs_matches_lazy_results(spark, tmp_path):
    from gridsla.sources.events import load_inputs
    jobs, alarms, imports = load_inputs(spark, "/root/testdata/sf0.001")
    lazy = SlaAnalysis(jobs, alarms, imports)
    written = SlaAnalysis(jobs, alarms, imports)
    paths = written.write_outputs(str(tmp_path))
    assert written.keep_power_facts and set(paths) == set(SlaAnalysis.OUTPUTS)
    for name in SlaAnalysis.OUTPUTS:
        want = getattr(lazy, name)()
        if name in SlaAnalysis.CSV_OUTPUTS:
            assert spark.read.option("header", True).csv(paths[name]).count() == want.count()
            continue
        back = spark.read.parquet(paths[name])
        if name in ("sla_report", "unknown_task_report"):  # the job_date of N/A rows is the time of the call
            assert back.filter("metric = 'N/A'").count() == want.filter("metric = 'N/A'").count() > 0
            back, want = (df.filter("metric <> 'N/A'") for df in (back, want))
        assert sorted(map(repr, back.collect())) == sorted(map(repr, want.collect())), name
    written.close()


def test_power_plans_read_the_written_window_rows(spark, tmp_path):
    """The job log is scanned for the anchors and the window rows only, and once more by the export's late jobs."""
    from gridsla.sources.events import load_inputs
    logs = []
    for name, df in zip(("jobs", "alarms", "imports"), load_inputs(spark, "/root/testdata/sf0.001")):
        df.write.parquet(str(tmp_path / name))
        logs.append(spark.read.parquet(str(tmp_path / name)))
    a = SlaAnalysis(*logs)
    for name, scans in (("meter_power_state", 0), ("power_summary", 0), ("prior_power_code", 0), ("flip_counts", 0),
                        ("flip_listing", 0), ("import_presence", 0), ("late_job_export", 1)):
        df = getattr(a, name)()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("createddate:timestamp_ntz") == scans, name
    a.close()


def test_narrowed_day_equals_full_run_and_alarm_days_input(spark):
    from pyspark.sql import functions as F

    from gridsla.operators.power import alarm_daily_summary
    from gridsla.sources.events import load_inputs
    jobs, alarms, imports = load_inputs(spark, "/root/testdata/sf0.01")
    full = SlaAnalysis(jobs, alarms, imports)
    day = "2024-01-17"
    one = SlaAnalysis(jobs, alarms, imports, day=day)
    want = sorted(map(tuple, full.meter_power_state()
                      .filter(F.col("job_day") == F.lit(f"{day} 00:00:00").cast("timestamp_ntz")).collect()))
    got = sorted(map(tuple, one.meter_power_state().collect()))
    assert got and got == want
    kept = SlaAnalysis(jobs, alarms, imports, alarm_days=alarm_daily_summary(alarms))
    assert sorted(map(tuple, kept.prior_power_code().collect())) == \
        sorted(map(tuple, full.prior_power_code().collect()))


def test_hot_meter_day_is_summarised_before_pairing(make_jobs, make_alarms, make_imports):
    """One meter carries most alarms of the day: its signals shrink to at most two
    summary rows per second before they meet any window."""
    from pyspark.sql import functions as F

    from gridsla.operators.power import signal_slots
    rng = random.Random(3)
    start = dt.datetime(2024, 6, 1, 8, 0, 0)
    jobs = [(i, AT, "g" if i % 2 else "h", "1", "HOT" if i < 40 else f"C{i}",
             start + dt.timedelta(minutes=(i % 2) * 17, milliseconds=rng.randint(0, 999)),
             start + dt.timedelta(minutes=rng.uniform(0, 500))) for i in range(60)]
    alarms = [("HOT", start + dt.timedelta(minutes=rng.uniform(-600, 900)), rng.choice(NAMES)) for _ in range(4000)]
    alarms += [(f"C{i}", start + dt.timedelta(minutes=rng.uniform(-600, 900)), rng.choice(NAMES))
               for i in range(40, 60) for _ in range(3)]
    imports = [("HOT", start + dt.timedelta(minutes=rng.uniform(0, 400))) for _ in range(500)]
    a = SlaAnalysis(make_jobs(jobs), make_alarms(alarms), make_imports(imports))
    slots = signal_slots(a.window_alarms, a.window_imports)
    per_day = slots.filter(F.col("meterid") == "HOT").groupBy("day").count().collect()
    assert per_day and all(r["count"] <= 2 * 86_400 for r in per_day)
    both = signal_slots(a.window_alarms.unionByName(a.window_alarms), a.window_imports)
    assert both.count() == slots.count()  # more signals in the same seconds make no more rows

    # and the states still follow the rules, checked per meter by brute force
    windows = {(r.batch_guid, r.sla_tier): (r.win_start, r.win_end) for r in a.tier_window().collect()}
    tiers = {(r.batch_guid, r.meterid, r.sla_tier) for r in a.meters_by_tier().collect()}
    mine = {}
    for m, t, n in alarms:
        mine.setdefault(m, []).append((t, n))
    imps = {}
    for m, t in imports:
        imps.setdefault(m, []).append(t)
    got = {(r.batch_guid, r.meterid, r.sla_tier): r.meter_power_state for r in a.meter_power_state().collect()}
    want = {}
    for g, m, tier in tiers:
        s, e = windows[(g, tier)]
        want[(g, m, tier)] = expected_state(mine.get(m, []), imps.get(m, []), s, e)
    assert got == want


def test_daily_summary_merge_equals_full_summary(spark):
    from pyspark.sql import functions as F

    from gridsla.operators.power import alarm_daily_summary, merge_alarm_daily_summary
    from gridsla.sources.events import load_inputs
    _, alarms, _ = load_inputs(spark, "/root/testdata/sf0.001")
    cut = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")   # the cut day is split across both parts
    kept = alarm_daily_summary(alarms.filter(F.col("alarm_date") < cut))
    merged = merge_alarm_daily_summary(kept, alarms.filter(F.col("alarm_date") >= cut))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, alarm_daily_summary(alarms).collect()))


def test_ten_thousand_batches_in_one_day(spark, make_jobs, make_alarms, make_imports):
    """Without any broadcast allowed, states equal brute force and nothing is dealt by day or hour alone."""
    rng = random.Random(9)
    start = dt.datetime(2024, 6, 1, 0, 0, 0)
    jobs = []
    for i in range(10_000):
        at = start + dt.timedelta(seconds=rng.randint(0, 60_000), milliseconds=rng.randint(0, 999))
        jobs.append((i, AT, f"g{i}", "1", f"M{i % 400}", at, at + dt.timedelta(minutes=rng.uniform(0, 500))))
    alarms = [(f"M{rng.randint(0, 400)}", start + dt.timedelta(minutes=rng.uniform(-3000, 2000)), rng.choice(NAMES))
              for _ in range(2_000)]
    imports = [(f"M{rng.randint(0, 400)}", start + dt.timedelta(minutes=rng.uniform(0, 1500))) for _ in range(1_000)]
    spark.conf.set("gridsla.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = SlaAnalysis(make_jobs(jobs), make_alarms(alarms), make_imports(imports))
        states = a.meter_power_state()
        plan = states._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(day#\d+, \d+\)|hashpartitioning\(day#\d+, hour#\d+", plan)
        got = {(r.batch_guid, r.meterid, r.sla_tier): r.meter_power_state for r in states.collect()}
        windows = {(r.batch_guid, r.sla_tier): (r.win_start, r.win_end) for r in a.tier_window().collect()}
    finally:
        spark.conf.unset("gridsla.broadcast.maxRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    mine, imps = {}, {}
    for m, t, n in alarms:
        mine.setdefault(m, []).append((t, n))
    for m, t in imports:
        imps.setdefault(m, []).append(t)
    assert len(got) == 10_000
    for (g, m, tier), state in got.items():
        assert state == expected_state(mine.get(m, []), imps.get(m, []), *windows[(g, tier)])


def test_one_meter_in_many_batches_has_one_start_per_day(spark, make_jobs, make_alarms):
    """The running maximum reads at most one start row a day and meter, however many batches share it."""
    from gridsla.operators.power import _earlier_days, alarm_daily_summary
    start = dt.datetime(2024, 6, 1)
    rows = spark.createDataFrame([("P", start + dt.timedelta(seconds=i)) for i in range(5_000)],
                                 "meterid string, win_start timestamp_ntz")
    alarms = make_alarms([("P", start - dt.timedelta(days=3), "METER_FIRST_BREATH"), ("Q", start, "METER_LAST_GASP")])
    earlier = _earlier_days(rows, ("meterid", "win_start"), alarm_daily_summary(alarms))
    assert earlier.count() == 5_000 and earlier.filter("alarms_before = 1").count() == 5_000


def test_outputs_with_one_log_and_requested_unknown_task(make_jobs, make_alarms, make_imports):
    at = dt.datetime(2024, 6, 1, 8)
    jobs = make_jobs([(1, AT, "g", "1", "A", at, at)])
    alarms, imports = make_alarms([("A", at, "METER_LAST_GASP")]), make_imports([("A", at)])
    assert [r.flip_count for r in SlaAnalysis(jobs, alarms).flip_counts().collect()] == [1]
    assert [r.import_in_window for r in SlaAnalysis(jobs, imports=imports).import_presence().collect()] == ["Yes"]
    for day in (None, "2024-06-02"):
        report = SlaAnalysis(jobs, task="nosuch", day=day).sla_report().collect()
        assert [(r.task, r.metric, r.total_jobs) for r in report] == [("nosuch", "N/A", 0)]


def test_job_log_without_a_key_column(spark):
    from gridsla.sources.tables import conform_jobs
    at = dt.datetime(2024, 6, 1, 8)
    rows = [("Alert / Tamper", "g", "1", f"M{i}", at, at + dt.timedelta(minutes=40)) for i in range(20)]
    log = spark.createDataFrame(rows, "mdastaskname string, guid string, status string, meterid string, "
                                      "createddate timestamp_ntz, completiondatetime timestamp_ntz")
    ids = [sorted(r.job_id for r in conform_jobs(log.repartition(n)).collect()) for n in (1, 7)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 20
    assert SlaAnalysis(conform_jobs(log)).sla_report().count() == 4
