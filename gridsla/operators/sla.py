"""The SLA report and the per-job tier: A4, A5, A9, A10, A11, A25.

Every report figure comes from one aggregate over the timed jobs: per batch the
total, the unfinished jobs and the finished jobs per exclusive tier. Cumulative
tier counts, percentages and gaps are then computed on that small table joined
to the policy (a local relation, broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import gap, percentage, target_count
from ..functions.tiers import known_task, tier_label, window_minutes
from ..functions.timecols import plus_minutes
from ..sources.policy import DEFAULT_POLICY, NO_GUID, UNKNOWN_METRIC, TaskPolicy, policy_frame
from .batches import BATCH_KEYS


def _max_tiers(policy) -> int:
    return max(len(p.tiers) for p in policy)


def tier_counts(timed: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """Per batch: total_jobs, unfinished_count and n1..nK, the finished jobs per exclusive tier."""
    done = F.col("completiondatetime").isNotNull()
    per_tier = [F.count_if(done & (F.col("sla_order") == k)).alias(f"n{k}")
                for k in range(1, _max_tiers(policy) + 1)]
    return (timed.groupBy(*BATCH_KEYS, "job_date")
            .agg(F.count(F.lit(1)).alias("total_jobs"),
                 F.count_if(~done).alias("unfinished_count"),
                 *per_tier))


def _with_policy(counts: DataFrame, policy) -> DataFrame:
    """Join the per-batch counts to the tier rows of their task; add cumulative counts."""
    spark = counts.sparkSession
    pol = policy_frame(spark, policy).withColumnRenamed("tier", "metric")
    k = _max_tiers(policy)
    # cum_order = finished jobs within the tier's limit (tiers are nested)
    cumulative = sum((F.when(F.col("tier_order") >= i, F.col(f"n{i}")).otherwise(F.lit(0))
                      for i in range(1, k + 1)), F.lit(0)).cast("long")
    cum_last = sum((F.when(F.col("last_timed_order") >= i, F.col(f"n{i}")).otherwise(F.lit(0))
                    for i in range(1, k + 1)), F.lit(0)).cast("long")
    own = None
    for i in range(1, k + 1):
        own = (F.when(F.col("tier_order") == i, F.col(f"n{i}")) if own is None
               else own.when(F.col("tier_order") == i, F.col(f"n{i}")))
    is_breach = F.col("limit_min").isNull()
    return (counts.join(F.broadcast(pol), "task")
            .withColumn("completed_count", F.when(is_breach, own.cast("long")).otherwise(cumulative))
            .withColumn("cum_last", cum_last))


def sla_report(counts: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY,
               unknown: DataFrame | None = None) -> DataFrame:
    """A4 (``counts``: ``tier_counts`` or ``histogram.histogram_counts``): per batch and tier the completed count, percentage and jobs pending to target.

    Tier rows count finished jobs within anchor + limit (cumulative); the breach
    row counts finished jobs beyond the last limit and its pending figure is the
    last tier's pending minus the breach count, floored at 0. Unfinished jobs
    count in the total only (``unfinished_count`` reports them). ``unknown``
    (``unknown_task_report`` rows) is appended.
    """
    rows = _with_policy(counts, policy)
    is_breach = F.col("limit_min").isNull()
    pending_tier = gap(target_count(F.col("total_jobs"), F.col("target")), F.col("completed_count"))
    pending_last = gap(target_count(F.col("total_jobs"), F.col("last_target")), F.col("cum_last"))
    out = rows.select(
        *BATCH_KEYS, "job_date", "total_jobs", "metric", "completed_count",
        percentage(F.col("completed_count"), F.col("total_jobs")).alias("percentage"),
        F.when(is_breach, gap(pending_last, F.col("completed_count"))).otherwise(pending_tier)
        .alias("pending_for_target"),
        F.col("tier_order").alias("sla_order"),
        "unfinished_count",
    )
    if unknown is not None:
        out = out.unionByName(unknown)
    return out.orderBy(*BATCH_KEYS, "sla_order")  # small: batches x tiers


def sla_gap(counts: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """A5 (``counts`` as in ``sla_report``): per batch and timed tier, max(ceil(total * target) - within limit, 0)."""
    rows = _with_policy(counts, policy).filter(F.col("limit_min").isNotNull())
    needed = target_count(F.col("total_jobs"), F.col("target"))
    return rows.select(*BATCH_KEYS, F.col("metric").alias("sla_tier"), F.col("tier_order").alias("sla_order"),
                       "total_jobs", F.col("completed_count").alias("within_limit"),
                       needed.alias("target_count"), gap(needed, F.col("completed_count")).alias("gap")
                       ).orderBy(*BATCH_KEYS, "sla_order")


def tier_of_job(timed: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """The exclusive tier of every job (an unfinished job is a breach)."""
    return timed.select(*BATCH_KEYS, "job_id", "meterid",
                        tier_label("task", "sla_order", policy).alias("sla_tier"),
                        "sla_order")


def meters_by_tier(timed: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """A10: the distinct meters of each batch and exclusive tier, one row per meter.

    The reference returns one array per tier; one row per (tier, meter) holds the
    same set without gathering a whole tier into one value.
    """
    return (timed.select(*BATCH_KEYS, "sla_order", "meterid").distinct()
            .withColumn("sla_tier", tier_label("task", "sla_order", policy))
            .select(*BATCH_KEYS, "sla_tier", "sla_order", "meterid"))


def tier_window(anchors: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """Per batch and tier the power-check window [anchor, anchor + limit];
    the breach tier takes the task's last limit."""
    pol = policy_frame(anchors.sparkSession, policy).select("task", "tier", "tier_order", "window_min")
    return (anchors.join(F.broadcast(pol), "task")
            .select(*BATCH_KEYS, F.col("tier").alias("sla_tier"), F.col("tier_order").alias("sla_order"),
                    F.col("job_date").alias("win_start"),
                    plus_minutes(F.col("job_date"), F.col("window_min")).alias("win_end")))


def with_window(meters: DataFrame, anchors: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """Meters of a tier with that tier's window; ``anchors`` is the prepared build
    side (``batches.anchor_side``: materialised, broadcast behind a row check)."""
    return (meters.join(anchors.select(*BATCH_KEYS, "job_date"), list(BATCH_KEYS))
            .select(*BATCH_KEYS, "sla_tier", "sla_order", "meterid",
                    F.col("job_date").alias("win_start"),
                    plus_minutes(F.col("job_date"),
                                 window_minutes("task", "sla_order", policy)).alias("win_end")))


def na_rows(task_days: DataFrame, with_time: bool = True) -> DataFrame:
    """The N/A report row for each (task, job_day) given."""
    cols = [F.col("task"), F.col("job_day"), F.lit(NO_GUID).alias("batch_guid")]
    if with_time:
        cols.append(F.localtimestamp().alias("job_date"))
    cols += [F.lit(0).cast("long").alias("total_jobs"), F.lit(UNKNOWN_METRIC).alias("metric"),
             F.lit(0).cast("long").alias("completed_count"), F.lit(0.0).alias("percentage"),
             F.lit(0).cast("long").alias("pending_for_target"), F.lit(1).alias("sla_order"),
             F.lit(0).cast("long").alias("unfinished_count")]
    return task_days.select(*cols)
