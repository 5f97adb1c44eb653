"""Power state per meter and window on hand-made alarms."""

from __future__ import annotations

import pytest

from gridsla.functions import power as PW
from gridsla.plans.analysis import SlaAnalysis

from .conftest import ts

AT = "Alert / Tamper"
FW = "serviceFirmwareUpdate"
ON, OFF, OTHER = "METER_FIRST_BREATH", "METER_LAST_GASP", "COVER_OPEN"
START, END = ts("2024-01-10 10:00:00"), ts("2024-01-10 10:30:00")


@pytest.fixture
def analysis(make_jobs, make_alarms, make_imports):
    meters = [f"M{i}" for i in range(1, 12)]
    jobs = [(i, AT, "g", "1", m, ts("2024-01-10 10:00:00.400"), ts("2024-01-10 10:10:00"))
            for i, m in enumerate(meters, start=1)]
    # a firmware batch late in the day: its 8 h window crosses midnight
    jobs.append((100, FW, "z", "1", "M20", ts("2024-01-10 23:00:00"), ts("2024-01-11 01:00:00")))
    alarms = [
        ("M1", ts("2024-01-10 10:15:00"), OFF),                 # lone power-off inside
        ("M2", ts("2024-01-09 08:00:00"), ON),                  # only an earlier power-on
        ("M3", ts("2024-01-10 09:00:00"), OTHER),               # only another alarm earlier
        ("M5", ts("2024-01-10 10:05:00"), f"{OFF},{ON}"),       # both names in one alarm
        ("M6", START, ON),                                      # exactly at the start
        ("M6", ts("2024-01-05 12:00:00"), OFF),
        ("M7", END, OFF),                                       # exactly at the end
        ("M8", ts("2024-01-08 07:00:00"), ON),
        ("M8", ts("2024-01-10 09:59:59.999"), OFF),             # same day, just before
        ("M9", ts("2024-01-08 07:00:00"), OFF),
        ("M9", ts("2024-01-10 09:00:00"), ON),
        ("M10", ts("2024-01-08 07:00:00"), OFF),
        ("M10", ts("2024-01-09 07:00:00"), ON),
        ("M10", ts("2024-01-10 11:00:00"), OFF),                # after the window: ignored
        ("M11", ts("2024-01-10 10:20:00"), ON),                 # tie on the newest flip
        ("M11", ts("2024-01-10 10:20:00"), OFF),
        ("M20", ts("2024-01-11 06:00:00"), ON),                 # next day, inside the window
        ("M20", ts("2024-01-10 22:00:00"), OFF),
    ]
    imports = [
        ("M3", ts("2024-01-10 10:01:00")),
        ("M8", ts("2024-01-10 10:29:59")),
        ("M9", START),
        ("M9", ts("2024-01-10 10:10:00")),
        ("M2", ts("2024-01-10 10:30:00.000001")),               # just after the window
    ]
    return SlaAnalysis(make_jobs(jobs), make_alarms(alarms), make_imports(imports))


def _by_meter(df):
    return {r.meterid: r for r in df.collect()}


def test_states(analysis):
    st = {m: r.meter_power_state for m, r in _by_meter(analysis.meter_power_state()).items()}
    assert st == {
        "M1": PW.STATE_INTERMITTENT,
        "M2": PW.STATE_OFF,                  # on-only earlier -> code 0; import after the window
        "M3": PW.STATE_ON_MISSED_BREATH,     # other alarm earlier -> code 0; import inside
        "M4": PW.STATE_OTHER,                # nothing earlier, nothing inside
        "M5": PW.STATE_INTERMITTENT,
        "M6": PW.STATE_INTERMITTENT,
        "M7": PW.STATE_INTERMITTENT,
        "M8": PW.STATE_ON_MISSED_BREATH,
        "M9": PW.STATE_ON,
        "M10": PW.STATE_OFF_MISSED_GASP,
        "M11": PW.STATE_INTERMITTENT,
        "M20": PW.STATE_INTERMITTENT,
    }


def test_prior_codes(analysis):
    pc = _by_meter(analysis.prior_power_code())
    assert "M4" not in pc and "M1" not in pc          # no alarm before the start: no row (code NULL)
    assert (pc["M2"].pre_status_code, pc["M2"].prior_is_certain) == (0, False)
    assert (pc["M3"].pre_status_code, pc["M3"].pre_status_time) == (0, ts("1900-01-01 00:00:00"))
    assert pc["M6"].pre_status_code == 0 and pc["M6"].pre_status_time == ts("2024-01-05 12:00:00")
    assert (pc["M8"].pre_status_code, pc["M8"].prior_is_certain) == (0, True)
    assert pc["M8"].pre_opposite_status_time == ts("2024-01-08 07:00:00")
    assert pc["M9"].pre_status_code == 1 and pc["M9"].pre_opposite_status_time == ts("2024-01-08 07:00:00")
    assert pc["M10"].pre_status_code == 1 and pc["M10"].pre_status_time == ts("2024-01-09 07:00:00")
    before = _by_meter(analysis.power_status_before())
    assert before["M8"].last_off_before == ts("2024-01-10 09:59:59.999")
    assert before["M20"].last_off_before == ts("2024-01-10 22:00:00")


def test_flips(analysis):
    counts = {m: r.flip_count for m, r in _by_meter(analysis.flip_counts()).items()}
    assert counts == {"M1": 1, "M5": 1, "M6": 1, "M7": 1, "M11": 2, "M20": 1}
    latest = _by_meter(analysis.latest_flip())
    assert latest["M5"].latest_state == 1                 # both names: power on
    assert latest["M11"].latest_state == 0                # tie: power-off wins
    assert latest["M7"].latest_event_time == END
    listing = {(r.meterid, r.flip_text) for r in analysis.flip_listing().collect()}
    assert ("M6", "METER_FIRST_BREATH @ 10-01-2024 10:00:00") in listing
    assert ("M20", "METER_FIRST_BREATH @ 11-01-2024 06:00:00") in listing


def test_imports(analysis):
    imp = _by_meter(analysis.import_presence())
    assert imp["M9"].import_in_window == "Yes" and imp["M9"].first_import_time == START
    assert imp["M2"].import_in_window == "No" and imp["M2"].first_import_time is None


def test_split_and_lists(analysis):
    split = _by_meter(analysis.power_split())
    off = {m for m, r in split.items() if r.powered_off}
    assert off == {"M2", "M10"}
    assert {r.meterid for r in analysis.powered_off_list().collect()} == off
    assert {r.meterid for r in analysis.eligible_list().collect()} == set(split) - off
    summary = analysis.power_summary().collect()
    at = [r for r in summary if r.task == AT][0]
    assert (at.total_meters, at.power_off_meters, at.after_removing_power_off) == (11, 2, 9)


def test_windows(analysis):
    w = {(r.task, r.sla_tier): (r.win_start, r.win_end) for r in analysis.tier_window().collect()}
    assert w[(AT, "30 Min SLA")] == (START, END)
    assert w[(AT, "SLA Breach")] == (START, ts("2024-01-10 16:00:00"))
    assert w[(FW, "8 Hour SLA")] == (ts("2024-01-10 23:00:00"), ts("2024-01-11 07:00:00"))


def test_window_longer_than_a_day(make_jobs, make_alarms, make_imports):
    """A custom policy whose last limit spans three days: alarms on the days
    strictly inside the window (no boundary falls on them) still count."""
    from decimal import Decimal

    from gridsla.sources.policy import Tier, TaskPolicy
    policy = (TaskPolicy("X", "slowTask", True, (Tier(1, "3 Day SLA", 4320, Decimal("0.9")),
                                                  Tier(2, "SLA Breach", None, None))),)
    start = ts("2024-02-01 12:00:00")
    jobs = make_jobs([(1, "slowTask", "g", "1", "L1", start, ts("2024-02-02 09:00:00")),
                      (2, "slowTask", "g", "1", "L2", start, ts("2024-02-02 09:00:00")),
                      (3, "slowTask", "g", "1", "L3", start, ts("2024-02-02 09:00:00"))])
    alarms = make_alarms([("L1", ts("2024-02-02 15:00:00"), "METER_LAST_GASP"),   # middle day
                          ("L2", ts("2024-01-30 08:00:00"), "METER_LAST_GASP"),
                          ("L2", ts("2024-01-31 08:00:00"), "METER_FIRST_BREATH")])
    imports = make_imports([("L2", ts("2024-02-03 23:59:00")),                   # middle day
                            ("L3", ts("2024-02-04 12:00:00.000001"))])          # just after the end
    a = SlaAnalysis(jobs, alarms, imports, policy)
    st = {r.meterid: r.meter_power_state for r in a.meter_power_state().collect()}
    assert st == {"L1": PW.STATE_INTERMITTENT, "L2": PW.STATE_ON, "L3": PW.STATE_OTHER}
    w = {r.sla_tier: (r.win_start, r.win_end) for r in a.tier_window().collect()}
    assert w["3 Day SLA"] == (start, ts("2024-02-04 12:00:00"))
