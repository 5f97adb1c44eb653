"""SLA report, gaps, tiers and late sets against a brute-force reading of the rules,
on seeded random batches (NULL completions, completions exactly on a limit,
sub-second creation times, several guids and days)."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

from gridsla.plans.analysis import SlaAnalysis
from gridsla.sources.policy import DEFAULT_POLICY


def _anchor(created):
    return min(created).replace(microsecond=0)


def expected(jobs):
    batches = {}
    policy = {p.task: p for p in DEFAULT_POLICY}
    for job_id, task, guid, _, meter, c, done in jobs:
        p = policy[task]
        if p.uses_guid and guid is None:
            continue
        key = (task, dt.datetime.combine(c.date(), dt.time()), guid if p.uses_guid else "ALL")
        batches.setdefault(key, []).append((job_id, c, done))
    report, late = {}, set()
    for key, rows in batches.items():
        p = policy[key[0]]
        anchor = _anchor([c for _, c, _ in rows])
        total = len(rows)
        pending_last = None
        for t in p.timed_tiers:
            deadline = anchor + dt.timedelta(minutes=t.limit_min)
            n = sum(1 for _, _, d in rows if d is not None and d <= deadline)
            pending = max(math.ceil(total * t.target) - n, 0)
            pct = float((Decimal(n) * 100 / Decimal(total)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
            report[(*key, t.label)] = (n, pct, pending)
            pending_last = pending
            late |= {(*key, t.label, j) for j, _, d in rows if d is not None and d > deadline}
        deadline = anchor + dt.timedelta(minutes=p.max_limit)
        b = sum(1 for _, _, d in rows if d is not None and d > deadline)
        pct = float((Decimal(b) * 100 / Decimal(total)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
        report[(*key, p.breach.label)] = (b, pct, max(pending_last - b, 0))
    return report, late


def test_random_batches(make_jobs):
    rng = random.Random(11)
    tasks = [p.task for p in DEFAULT_POLICY]
    jobs = []
    for i in range(3000):
        task = rng.choice(tasks)
        day = dt.datetime(2024, 5, rng.randint(1, 3))
        created = day + dt.timedelta(seconds=rng.randint(0, 300), microseconds=rng.choice([0, 999999, rng.randint(0, 999999)]))
        limits = [t.limit_min for p in DEFAULT_POLICY if p.task == task for t in p.timed_tiers]
        pick = rng.random()
        if pick < 0.05:
            done = None
        elif pick < 0.25:
            # exactly on a limit, measured from the truncated first creation of the day
            done = day + dt.timedelta(minutes=rng.choice(limits))
        else:
            done = created + dt.timedelta(minutes=rng.uniform(0, 1.3 * limits[-1]))
        guid = rng.choice(["a", "b", "c", None] if i % 50 == 0 else ["a", "b", "c"])
        jobs.append((i, task, guid, "1", f"M{rng.randint(0, 400)}", created, done))
    a = SlaAnalysis(make_jobs(jobs))
    want_report, want_late = expected(jobs)
    got = {(r.task, r.job_day, r.batch_guid, r.metric): (r.completed_count, r.percentage, r.pending_for_target)
           for r in a.sla_report().collect()}
    assert got == want_report
    got_late = {(r.task, r.job_day, r.batch_guid, r.sla_tier, r.job_id) for r in a.late_jobs().collect()}
    assert got_late == want_late
