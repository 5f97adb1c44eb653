"""Late jobs, a repeatable review sample of them, their summary and export: A6, A7, A8, A24.

Only measured values leave these operators: completion times are the input's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import gap, target_count
from ..functions.tiers import tier_label, tier_limit
from ..functions.timecols import minutes_between, plus_minutes
from ..sources.policy import DEFAULT_POLICY, TaskPolicy
from .batches import BATCH_KEYS
from .sla import _with_policy

DEFAULT_SAMPLE = 20


def late_jobs(timed: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """Per timed tier, the finished jobs with completion > anchor + limit.

    A job that reached exclusive tier k missed tiers 1..k-1, so it is emitted
    once per missed tier by a generator (no join). Unfinished jobs are in no set.
    """
    missed = F.explode(F.sequence(F.lit(1), F.col("sla_order") - 1))
    late = (timed.filter(F.col("completiondatetime").isNotNull() & (F.col("sla_order") > 1))
            .select(*BATCH_KEYS, "job_id", "meterid", "createddate", "completiondatetime", "job_date",
                    F.col("sla_order").alias("completed_order"), missed.alias("sla_order")))
    deadline = plus_minutes(F.col("job_date"), tier_limit("task", "sla_order", policy))
    return late.select(
        *BATCH_KEYS,
        tier_label("task", "sla_order", policy).alias("sla_tier"), "sla_order",
        "job_id", "meterid", "createddate", "completiondatetime",
        deadline.alias("deadline"),
        minutes_between(deadline, F.col("completiondatetime")).alias("overdue_minutes"),
        tier_label("task", "completed_order", policy).alias("completed_tier"),
        "completed_order",
    )


def sample_key(job_id, seed: int):
    """Repeatable order: md5 of the job id and the seed; independent of partitioning."""
    return F.md5(F.concat(job_id.cast("string"), F.lit(f":{seed}")))


def late_job_sample(late: DataFrame, n: int = DEFAULT_SAMPLE, seed: int = 0) -> DataFrame:
    """Up to ``n`` late jobs per batch and tier for review, chosen by a seeded hash.

    ``row_number() <= n`` lets Spark put a partial group limit before the
    shuffle, so even a huge batch ships at most n rows per map task.
    """
    w = Window.partitionBy(*BATCH_KEYS, "sla_order").orderBy(sample_key(F.col("job_id"), seed), F.col("job_id"))
    return (late.withColumn("sample_rank", F.row_number().over(w))
            .filter(F.col("sample_rank") <= F.lit(n)))


def late_summary(counts: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """A8 (``counts`` as in ``sla.sla_report``): per batch, (metric, value) rows: late jobs and gap per timed tier, and
    the distinct late jobs over all tiers (= late for the first tier, as sets nest)."""
    rows = _with_policy(counts, policy).filter(F.col("limit_min").isNotNull())
    finished = F.col("total_jobs") - F.col("unfinished_count")
    late_n = (finished - F.col("completed_count")).cast("long")
    gap_n = gap(target_count(F.col("total_jobs"), F.col("target")), F.col("completed_count"))
    per_tier = rows.select(*BATCH_KEYS, F.explode(F.array(
        F.struct(F.concat(F.col("metric"), F.lit(" late jobs")).alias("metric"), late_n.alias("value")),
        F.struct(F.concat(F.col("metric"), F.lit(" gap")).alias("metric"), gap_n.alias("value")),
    )).alias("m"))
    distinct = rows.filter(F.col("tier_order") == 1).select(
        *BATCH_KEYS, F.struct(F.lit("distinct late jobs").alias("metric"), late_n.alias("value")).alias("m"))
    return per_tier.unionByName(distinct).select(*BATCH_KEYS, "m.metric", "m.value")


def late_job_export(late: DataFrame, states: DataFrame) -> DataFrame:
    """Late jobs with the tier missed, the measured completion, minutes overdue
    and the meter's power state in the window of the tier the job completed in."""
    st = states.select(*BATCH_KEYS, F.col("sla_order").alias("completed_order"), "meterid", "meter_power_state")
    return (late.join(st, [*BATCH_KEYS, "completed_order", "meterid"], "left")
            .select(*BATCH_KEYS, "job_id", "meterid", F.col("sla_tier").alias("missed_tier"),
                    "completed_tier", "completiondatetime", "overdue_minutes", "meter_power_state"))
