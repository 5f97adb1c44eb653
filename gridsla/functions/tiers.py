"""The SLA policy compiled into column expressions.

Each helper returns one CASE expression over the task column, so a job's tier,
label and window are computed in the scan stage (codegen, no join, no fan-out).
The CASE is rendered as SQL text and parsed once (one call to the JVM per
expression instead of one per branch); arguments are column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.policy import DEFAULT_POLICY, TaskPolicy, validate


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ref(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _by_task(task: str, policy: tuple[TaskPolicy, ...], value: Callable[[TaskPolicy], str]) -> Column:
    arms = " ".join(f"WHEN {_lit(p.task)} THEN {value(p)}" for p in validate(policy))
    return F.expr(f"CASE {_ref(task)} {arms} END")  # NULL for a task without policy


def known_task(task: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> Column:
    return F.col(task).isin([p.task for p in policy])


def uses_guid(task: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> Column:
    return _by_task(task, policy, lambda p: "true" if p.uses_guid else "false")


def _within(done: str, anchor: str, minutes: int) -> str:
    return f"{_ref(done)} <= timestampadd(MINUTE, {int(minutes)}, {_ref(anchor)})"


def tier_of(task: str, done: str, anchor: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> Column:
    """Exclusive tier order: the first tier with done <= anchor + limit, else breach.

    A NULL completion falls through every comparison to the breach tier, like a
    CASE ... ELSE 'SLA Breach'.
    """
    def ladder(p: TaskPolicy) -> str:
        arms = " ".join(f"WHEN {_within(done, anchor, t.limit_min)} THEN {t.order}" for t in p.timed_tiers)
        return f"(CASE {arms} ELSE {p.breach.order} END)"
    return _by_task(task, policy, ladder)


def _by_tier(task: str, order: str, policy, value: Callable[[TaskPolicy, object], str]) -> Column:
    def per_task(p: TaskPolicy) -> str:
        arms = " ".join(f"WHEN {t.order} THEN {value(p, t)}" for t in p.tiers)
        return f"(CASE {_ref(order)} {arms} END)"
    return _by_task(task, policy, per_task)


def tier_label(task: str, order: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> Column:
    return _by_tier(task, order, policy, lambda p, t: _lit(t.label))


def tier_limit(task: str, order: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> Column:
    """Limit in minutes of a timed tier; NULL for the breach tier."""
    return _by_tier(task, order, policy,
                    lambda p, t: "CAST(NULL AS INT)" if t.is_breach else str(int(t.limit_min)))


def window_minutes(task: str, order: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> Column:
    """Power-check window length of a tier (breach: the task's last limit)."""
    return _by_tier(task, order, policy, lambda p, t: str(int(p.window_limit(t))))
