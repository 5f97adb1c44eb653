"""The SLA policy: task types, their tiers, limits and targets.

The policy is configuration, not data: a handful of rows known on the driver.
It is kept as Python values so the tier rules can be compiled into one CASE
expression (no join, no fan-out, stays inside whole-stage codegen), and it can
be turned into a small DataFrame where a relational form is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BREACH = "SLA Breach"
UNKNOWN_METRIC = "N/A"
NO_GUID = "ALL"


@dataclass(frozen=True)
class Tier:
    order: int
    label: str
    limit_min: int | None  # None for the breach tier
    target: Decimal | None  # None for the breach tier

    @property
    def is_breach(self) -> bool:
        return self.limit_min is None


@dataclass(frozen=True)
class TaskPolicy:
    tc: str
    task: str
    uses_guid: bool
    tiers: tuple[Tier, ...]

    @property
    def timed_tiers(self) -> tuple[Tier, ...]:
        return tuple(t for t in self.tiers if not t.is_breach)

    @property
    def breach(self) -> Tier:
        return next(t for t in self.tiers if t.is_breach)

    @property
    def max_limit(self) -> int:
        return max(t.limit_min for t in self.timed_tiers)

    def window_limit(self, tier: Tier) -> int:
        """Length of the power-check window of a tier; the breach tier takes the last limit."""
        return self.max_limit if tier.is_breach else tier.limit_min


def _tiers(*rows: tuple[str, int | None, str | None]) -> tuple[Tier, ...]:
    return tuple(
        Tier(i + 1, label, limit, Decimal(target) if target is not None else None)
        for i, (label, limit, target) in enumerate(rows)
    )


# Task names, tier labels, limits in minutes and completion
# targets, which must equal the reference's for the same results. The trailing
# comma in "Instant,Load Survey," is part of the task name.
DEFAULT_POLICY: tuple[TaskPolicy, ...] = (
    TaskPolicy("TC-12", "Alert / Tamper", True, _tiers(
        ("30 Min SLA", 30, "0.90"),
        ("60 Min SLA", 60, "0.99"),
        ("6 Hour SLA", 360, "0.999"),
        (BREACH, None, None),
    )),
    TaskPolicy("TC-18", "Instant,Load Survey,", True, _tiers(
        ("2 Hour SLA", 120, "0.95"),
        ("4 Hour SLA", 240, "1.00"),
        (BREACH, None, None),
    )),
    TaskPolicy("TC-10", "serviceFirmwareUpdate", False, _tiers(
        ("8 Hour SLA", 480, "0.99"),
        ("24 Hour SLA", 1440, "0.999"),
        (BREACH, None, None),
    )),
    TaskPolicy("TC-11", "serviceSetLoadLimit", True, _tiers(
        ("18 Hour SLA", 1080, "0.99"),
        ("24 Hour SLA", 1440, "0.999"),
        (BREACH, None, None),
    )),
)


def validate(policy: tuple[TaskPolicy, ...]) -> tuple[TaskPolicy, ...]:
    """Tiers must be numbered 1..n, limits strictly ascending, breach last."""
    seen = set()
    for p in policy:
        if p.task in seen:
            raise ValueError(f"task {p.task!r} appears twice in the policy")
        seen.add(p.task)
        if [t.order for t in p.tiers] != list(range(1, len(p.tiers) + 1)):
            raise ValueError(f"tiers of {p.task!r} must be numbered 1..n")
        if not p.tiers[-1].is_breach or any(t.is_breach for t in p.tiers[:-1]):
            raise ValueError(f"{p.task!r} needs exactly one breach tier, last")
        limits = [t.limit_min for t in p.timed_tiers]
        if not limits or any(a >= b for a, b in zip(limits, limits[1:])):
            raise ValueError(f"limits of {p.task!r} must be strictly ascending")
    return policy


POLICY_SCHEMA = T.StructType([
    T.StructField("tc", T.StringType(), False),
    T.StructField("task", T.StringType(), False),
    T.StructField("uses_guid", T.BooleanType(), False),
    T.StructField("tier_order", T.IntegerType(), False),
    T.StructField("tier", T.StringType(), False),
    T.StructField("limit_min", T.IntegerType(), True),
    T.StructField("window_min", T.IntegerType(), False),
    T.StructField("target", T.DecimalType(4, 3), True),
    T.StructField("last_timed_order", T.IntegerType(), False),
    T.StructField("last_target", T.DecimalType(4, 3), False),
])


def task_of_code(policy: tuple[TaskPolicy, ...], tc: str, task: str | None = None) -> str:
    """The task whose policy has the code ``tc``; an error if there is none, or ``task`` names another."""
    found = [p.task for p in policy if p.tc == tc]
    if not found:
        raise ValueError(f"no task with code {tc!r}")
    if task not in (None, found[0]):
        raise ValueError(f"code {tc!r} belongs to {found[0]!r}, not to {task!r}")
    return found[0]


def policy_frame(spark: SparkSession, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """One row per (task, tier); a local relation the planner always broadcasts."""
    rows = [
        (p.tc, p.task, p.uses_guid, t.order, t.label, t.limit_min, p.window_limit(t), t.target,
         p.timed_tiers[-1].order, p.timed_tiers[-1].target)
        for p in validate(policy)
        for t in p.tiers
    ]
    return spark.createDataFrame(rows, POLICY_SCHEMA)
