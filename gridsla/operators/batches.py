"""Batches of jobs, their anchor instant, per-job durations and the oldest open guid.

A batch is the set of jobs of one task created on one day under one guid; for
a task whose policy ignores the guid, all of the day's jobs form one batch
(guid reported as ``ALL``). Every operator works on all batches at once;
``task``/``day``/``guid`` narrow it like the reference's call arguments.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import known_task, tier_of, uses_guid
from ..functions.timecols import day_start, minutes_between, trunc_second
from ..plans.materialize import broadcast_if_small, materialize
from ..sources.policy import DEFAULT_POLICY, NO_GUID, TaskPolicy

BATCH_KEYS = ("task", "job_day", "batch_guid")


def _day(day) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def select_jobs(jobs: DataFrame, task: str | None = None, day=None) -> DataFrame:
    """Narrow the job log; the day test becomes a range on createddate, pushed to the scan.

    A row without createddate belongs to no day and is in no output.
    """
    jobs = jobs.filter(F.col("createddate").isNotNull())
    if task is not None:
        jobs = jobs.filter(F.col("task") == task)
    if day is not None:
        first = _day(day)
        lo = F.lit(f"{first.isoformat()} 00:00:00").cast("timestamp_ntz")  # zone-free literal
        hi = F.lit(f"{(first + dt.timedelta(days=1)).isoformat()} 00:00:00").cast("timestamp_ntz")
        jobs = jobs.filter((F.col("createddate") >= lo) & (F.col("createddate") < hi))
    return jobs


def assign_batches(jobs: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY, *,
                   task: str | None = None, day=None, guid: str | None = None,
                   include_unknown: bool = False) -> DataFrame:
    """Jobs with their batch keys (task, job_day, batch_guid).

    A job of a guid task without guid belongs to no batch (no guid can select it).
    A ``guid`` filter applies to guid tasks only, as the reference ignores it
    otherwise. Tasks without policy are dropped, or with ``include_unknown``
    kept as one batch per task and day (guid ``ALL``) for the N/A rows.
    """
    jobs = select_jobs(jobs, task, day)
    if not include_unknown:
        jobs = jobs.filter(known_task("task", policy))
    by_guid = F.coalesce(uses_guid("task", policy), F.lit(False))
    out = (jobs.withColumn("job_day", day_start(F.col("createddate")))
           .withColumn("batch_guid", F.when(by_guid, F.col("guid")).otherwise(F.lit(NO_GUID)))
           .filter(F.col("batch_guid").isNotNull()))
    if guid is not None:
        out = out.filter(~by_guid | (F.col("guid") == guid))
    return out


def batch_anchor(batched: DataFrame) -> DataFrame:
    """A2: per batch the first creation time truncated to the second, and the job count."""
    return (batched.groupBy(*BATCH_KEYS)
            .agg(trunc_second(F.min("createddate")).alias("job_date"),
                 F.count(F.lit(1)).alias("total_jobs")))


def anchor_side(anchors: DataFrame) -> DataFrame:
    """The anchors as the build side of a join: materialised, broadcast behind a row check."""
    return checked_broadcast(anchors.select(*BATCH_KEYS, "job_date"))


def timed_jobs(batched: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY,
               anchors: DataFrame | None = None) -> DataFrame:
    """Jobs with their batch anchor (``job_date``) and exclusive tier (``sla_order``).

    ``anchors`` is the prepared build side (``anchor_side``). The anchors are one
    row per batch, materialised and broadcast behind a row check, so the job log
    is not shuffled before the aggregates that follow.
    """
    small = anchor_side(batch_anchor(batched)) if anchors is None else anchors
    return (batched.join(small.select(*BATCH_KEYS, "job_date"), list(BATCH_KEYS))
            .withColumn("sla_order", tier_of("task", "completiondatetime", "job_date", policy)))


def job_durations(jobs: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY, **narrow) -> DataFrame:
    """A3: completion minus creation in minutes, per job of a batch (NULL if unfinished)."""
    return (assign_batches(jobs, policy, **narrow)
            .select(*BATCH_KEYS, "job_id", "meterid", "createddate", "completiondatetime",
                    minutes_between(F.col("createddate"), F.col("completiondatetime"))
                    .alias("duration_minutes")))


def oldest_open_guid(jobs: DataFrame, task: str | None = None, day=None, keep=materialize) -> DataFrame:
    """A1: per task and day, the guid of the earliest created job with status '1'.

    Two hash-friendly steps instead of a min over (time, guid) structs, which
    would sort the whole open-job log: the first open instant per task and day
    (partial hash aggregate), then the smallest guid among the jobs at exactly
    that instant (the one-row-per-task-and-day table is broadcast behind a row
    check). ``keep`` writes that table. Ties on the instant go to the smaller guid, NULL first.
    """
    open_jobs = (select_jobs(jobs, task, day).filter(F.col("status") == "1")
                 .select("task", day_start(F.col("createddate")).alias("job_day"), "createddate", "guid"))
    first = (open_jobs.groupBy("task", "job_day")
             .agg(F.min("createddate").alias("first_open_createddate")))
    at_first = open_jobs.join(broadcast_if_small(keep(first)), ["task", "job_day"]).filter(
        F.col("createddate") == F.col("first_open_createddate"))
    return (at_first.groupBy("task", "job_day", "first_open_createddate")
            .agg(F.bool_or(F.col("guid").isNull()).alias("_has_null"), F.min("guid").alias("_min_guid"))
            .select("task", "job_day",
                    F.when(F.col("_has_null"), F.lit(None).cast("string")).otherwise(F.col("_min_guid")).alias("guid"),
                    "first_open_createddate"))
