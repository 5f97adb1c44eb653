"""Rows that no output holds: their reasons, their counts, and a table of them.

Outputs leave out jobs without a creation time (they belong to no day), jobs of a guid task without a guid (no guid selects
them) and signals without a time or a meter. These rows are not errors of a run, but a user should see them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.tiers import uses_guid
from ..sources.policy import DEFAULT_POLICY, TaskPolicy

NO_CREATION, NO_BATCH_GUID, NO_TIME, NO_METER = "no creation time", "no guid", "no time", "no meter"
REASONS = {"jobs": (NO_CREATION, NO_BATCH_GUID), "alarms": (NO_TIME, NO_METER), "imports": (NO_TIME, NO_METER)}
_SIGNAL_COLUMNS = {"alarms": ("alarm_date", "meterid"), "imports": ("das_rtc", "meter_id")}


def reject_reason(log: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> Column:
    """The first reason why a row of ``jobs``, ``alarms`` or ``imports`` is in no output; null if it is in one."""
    if log == "jobs":
        no_guid = F.coalesce(uses_guid("task", policy), F.lit(False)) & F.col("guid").isNull()
        return F.when(F.col("createddate").isNull(), NO_CREATION).when(no_guid, NO_BATCH_GUID)
    time, meter = _SIGNAL_COLUMNS[log]
    return F.when(F.col(time).isNull(), NO_TIME).when(F.col(meter).isNull(), NO_METER)


def rejected(log_rows: DataFrame, log: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """The rows of a log that no output holds, with ``reject_reason``."""
    return log_rows.withColumn("reject_reason", reject_reason(log, policy)).filter(F.col("reject_reason").isNotNull())


def reject_counts(logs: dict[str, DataFrame], policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """(log, outcome, n_rows) for each log: rows kept and rows of every reason, zeros included."""
    parts = None
    for name, rows in logs.items():
        reason = F.coalesce(reject_reason(name, policy), F.lit("kept"))
        counts = rows.agg(*[F.count_if(reason == r).alias(r) for r in ("kept", *REASONS[name])])
        one = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("log"), F.lit(r).alias("outcome"),
                                                         F.col(f"`{r}`").alias("n_rows")) for r in ("kept", *REASONS[name])]))
                            .alias("x")).select("x.*")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def observed(log_rows: DataFrame, log: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> tuple[DataFrame, Observation]:
    """The log with a counter of kept and rejected rows that fills while any output is computed (no further scan).

    ``Observation.get`` waits for the first action that reads the log to its end.
    """
    counter = Observation(f"{log} rows")
    reason = F.coalesce(reject_reason(log, policy), F.lit("kept"))
    return log_rows.observe(counter, *[F.count_if(reason == r).alias(r) for r in ("kept", *REASONS[log])]), counter
