"""The signal filter by meter, windows answered at their bounds, and the check of given meters and spans."""

from __future__ import annotations

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsla.operators import power as P
from gridsla.plans.analysis import SlaAnalysis
from gridsla.plans.meter_check import MeterCheck, check_power_off_meters
from tests.test_power_bruteforce import NAMES, expected_state

DAY = dt.datetime(2024, 6, 1)


def ancestors(plan: str, leaf: str) -> list[list[str]]:
    """For each line that matches ``leaf``, the lines above it in the tree, nearest first."""
    lines = [(re.search(r"[A-Za-z*(]", x).start(), x) for x in plan.splitlines() if re.search(r"[A-Za-z]", x)]
    out = []
    for k, (depth, text) in enumerate(lines):
        if re.search(leaf, text):
            path = []
            for d, t in reversed(lines[:k]):
                if d < depth:
                    path.append(t)
                    depth = d
            out.append(path)
    return out


@pytest.mark.parametrize("limit", [2_000_000, 3])
def test_one_batch_filters_signals_by_meter_before_any_shuffle(spark, tmp_path, limit):
    from gridsla.sources.events import load_inputs
    logs = []
    for name, df in zip(("jobs", "alarms", "imports"), load_inputs(spark, "/root/testdata/sf0.001")):
        df.write.parquet(str(tmp_path / name))
        logs.append(spark.read.parquet(str(tmp_path / name)))
    full = SlaAnalysis(*logs)
    one = full.anchors.filter("task = 'serviceSetLoadLimit'").orderBy("job_day", "batch_guid").first()
    spark.conf.set("gridsla.broadcast.maxRows", str(limit))
    try:
        a = SlaAnalysis(*logs, task=one.task, day=str(one.job_day.date()), guid=one.batch_guid)
        states = a.meter_power_state()
        got = sorted(map(tuple, states.collect()))
    finally:
        spark.conf.unset("gridsla.broadcast.maxRows")
    plan = states._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    for log in (r"FileScan parquet \[meterid#\d+,alarm_date#", r"FileScan parquet \[meter_id#"):
        paths = ancestors(plan, log)
        assert paths, plan
        for path in paths:
            before = path[:next(i for i, x in enumerate(path) if "Exchange" in x)]
            assert any("BroadcastHashJoin" in x and "LeftSemi" in x for x in before), (log, path)
    want = full.meter_power_state().filter(
        (F.col("task") == one.task) & (F.col("batch_guid") == one.batch_guid)
        & (F.col("job_day") == F.lit(str(one.job_day)).cast("timestamp_ntz")))
    assert got and got == sorted(map(tuple, want.collect()))


def test_bloom_filter_keeps_every_wanted_meter_and_few_others(spark):
    meters = spark.range(3_000).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("meterid"))
    log = spark.range(60_000).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("m"))
    passed = P.signal_filter(meters, 3_000, max_rows=1_000)(log, "m")
    numbers = {int(r.m[1:]) for r in passed.collect()}
    assert set(range(3_000)) <= numbers and len(numbers) < 3_000 + 0.15 * 57_000
    exact = P.signal_filter(meters, 3_000, max_rows=3_000)(log, "m")
    assert exact.count() == 3_000
    assert P.signal_filter(meters, 3_000, max_rows=10)(log, "m").count() == 60_000  # a full filter is left out


def test_hot_meter_costs_slots_plus_windows(spark):
    """172,800 slots of one meter-day and 5,000 windows: no pairing, and the counts of a plain search."""
    rng = np.random.default_rng(4)
    half = spark.range(172_800).select(
        F.lit("HOT").alias("meterid"),
        F.timestamp_add("MICROSECOND", (F.col("id") / 2).cast("long") * 1_000_000 + (F.col("id") % 2) * 500_000,
                        F.lit(DAY.isoformat(sep=" ")).cast("timestamp_ntz")).alias("t"), "id")
    alarms = half.filter("id % 3 = 0").select("meterid", F.col("t").alias("alarm_date"), F.lit(NAMES[0]).alias("alarm_names"))
    imports = half.filter("id % 3 = 1").select(F.col("meterid").alias("meter_id"), F.col("t").alias("das_rtc"))
    starts = rng.integers(0, 80_000, 5_000)
    lengths = rng.integers(0, 6_000, 5_000)
    rows = spark.createDataFrame(
        [("HOT", DAY + dt.timedelta(seconds=int(s)), DAY + dt.timedelta(seconds=int(s + n)), k)
         for k, (s, n) in enumerate(zip(starts, lengths))], "meterid string, win_start timestamp_ntz, win_end timestamp_ntz, k int")
    slots = P.signal_slots(alarms, imports)
    assert slots.count() == 115_200  # two thirds of the half seconds carry a signal
    found = P._bound_contributions(rows, ("k", "meterid"), slots)
    assert found.count() <= 2 * 2 * 5_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = {r.k: r for r in P._aggregate(found, ("k",)).collect()}
    ids = np.arange(172_800)
    at = {kind: (ids[ids % 3 == kind] // 2) * 2 + ids[ids % 3 == kind] % 2 for kind in (0, 1)}  # in half seconds
    for k, (s, n) in enumerate(zip(starts, lengths)):
        lo, hi = 2 * s, 2 * (s + n)
        counts = [np.searchsorted(at[x], hi, "right") - np.searchsorted(at[x], lo, "left") for x in (0, 1)]
        assert (got[k].flip_count, got[k].import_count) == tuple(counts)
        if counts[1]:
            first = at[1][np.searchsorted(at[1], lo, "left")]
            assert got[k].first_import_time == DAY + dt.timedelta(seconds=float(first) / 2)
        else:
            assert got[k].first_import_time is None


def test_spans_of_any_precision_equal_brute_force(spark, make_alarms, make_imports):
    rng = random.Random(21)
    spans, alarms, imports = [], {}, {}
    for i in range(150):
        meter = f"S{i % 60}"
        start = DAY + dt.timedelta(microseconds=rng.randint(0, 3 * 86_400_000_000))
        end = start + dt.timedelta(microseconds=rng.choice([0, 1, 999_999, rng.randint(0, 40_000_000_000), -5_000_000]))
        spans.append((meter, start, end))
        us = dt.timedelta(microseconds=1)
        points = [start, end, start - us, start + us, end - us, end + us, start.replace(microsecond=0), end.replace(microsecond=0)]
        for _ in range(rng.randint(0, 4)):
            t = rng.choice([*points, start + dt.timedelta(minutes=rng.uniform(-4_000, 600))])
            alarms.setdefault(meter, []).append((t, rng.choice(NAMES)))
        for _ in range(rng.randint(0, 2)):
            imports.setdefault(meter, []).append(rng.choice([*points, start + dt.timedelta(minutes=rng.uniform(-60, 600))]))
    given = spark.createDataFrame([*spans, spans[0], (None, DAY, DAY), ("S1", None, DAY)],
                                  "meterid string, win_start timestamp_ntz, win_end timestamp_ntz")
    other = [("UNASKED", DAY + dt.timedelta(minutes=k), NAMES[0]) for k in range(50)]
    check = MeterCheck(given, make_alarms([(m, t, n) for m, x in alarms.items() for t, n in x] + other),
                       make_imports([(m, t) for m, x in imports.items() for t in x]))
    got = {(r.meterid, r.win_start, r.win_end): r for r in check.report().collect()}
    check.close()
    assert set(got) == set(spans)
    for key, r in got.items():
        mine, seen = alarms.get(key[0], []), imports.get(key[0], [])
        assert r.meter_power_state == expected_state(mine, seen, *key[1:]), key
        flips = [t for t, n in mine if key[1] <= t <= key[2] and ("BREATH" in n or "GASP" in n)]
        inside = [t for t in seen if key[1] <= t <= key[2]]
        assert (r.flip_count, r.latest_event_time) == (len(flips), max(flips, default=None))
        assert (r.import_in_window, r.first_import_time) == ("Yes" if inside else "No", min(inside, default=None))
    assert len({r.meter_power_state for r in got.values()}) >= 5


def test_a_typed_list_of_meters(make_alarms, make_imports):
    alarms = make_alarms([("7", DAY - dt.timedelta(days=40), "METER_LAST_GASP"), ("8", DAY, "xMETER_FIRST_BREATHx"),
                          ("9", DAY, "METERxFIRSTxBREATH")])  # _ stands for any character
    imports = make_imports([("7", DAY + dt.timedelta(microseconds=1))])
    span = (DAY - dt.timedelta(microseconds=1), DAY + dt.timedelta(microseconds=1))
    got = [tuple(r) for r in check_power_off_meters([9, 7, "8", 7, None, 10], *span, alarms, imports).collect()]
    assert got == [("10", "Other than rules defined"), ("7", "Meter is Powered On (First Breath alert possibly missed)"),
                   ("8", "Meter is Powered On but communication is intermittent"),
                   ("9", "Meter is Powered On but communication is intermittent")]
    assert check_power_off_meters([], *span, alarms, imports).collect() == []
