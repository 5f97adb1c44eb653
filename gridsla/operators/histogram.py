"""The report from one scan: a mergeable histogram of completions per batch, and its kept table.

A batch's clock starts at its first creation, which is known only after all of the batch has been read. Tier limits
are whole minutes and the clock a whole second, so it is enough to count completions per second: a histogram row
is (batch, completion slot) with the number of jobs and the first creation among them. Rows of one key merge by
sum and minimum, so days, late rows and parts of a log can be folded in any order, and every tier is read off the
histogram once the clock is known.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tiers import known_task, tier_of, uses_guid
from ..functions.timecols import trunc_second
from ..plans.materialize import discard, materialize
from ..sources.policy import DEFAULT_POLICY, TaskPolicy
from .batches import BATCH_KEYS, assign_batches
from .sla import _max_tiers

HISTOGRAM = ("done", "jobs", "first_created")


def batch_histogram(jobs: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY, **narrow) -> DataFrame:
    """Per batch and completion slot: done, jobs, first_created.

    ``done`` is the completion cut to the second, one microsecond later for completions inside the second, and null
    for unfinished jobs: for a limit on a whole second, done <= limit is what completion <= limit is. Tasks without
    policy are in (one batch per task and day). A partial aggregate; one scan of five columns.
    """
    whole = trunc_second(F.col("completiondatetime"))
    done = F.when(whole == F.col("completiondatetime"), whole).otherwise(F.timestamp_add("MICROSECOND", F.lit(1), whole))
    return merge_histograms(
        assign_batches(jobs, policy, include_unknown=True, **narrow)
        .select(*BATCH_KEYS, done.alias("done"), F.lit(1).cast("long").alias("jobs"), F.col("createddate").alias("first_created")))


def merge_histograms(rows: DataFrame) -> DataFrame:
    """Histogram rows of any number of parts, merged."""
    return rows.groupBy(*BATCH_KEYS, "done").agg(F.sum("jobs").cast("long").alias("jobs"), F.min("first_created").alias("first_created"))


def narrow_histogram(histogram: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY, task: str | None = None,
                     day=None, guid: str | None = None) -> DataFrame:
    """A histogram narrowed as ``assign_batches`` narrows jobs (a guid picks batches of guid tasks only)."""
    if task is not None:
        histogram = histogram.filter(F.col("task") == task)
    if day is not None:
        histogram = histogram.filter(F.to_date("job_day") == F.lit(str(day)).cast("date"))
    if guid is not None:
        by_guid = F.coalesce(uses_guid("task", policy), F.lit(False))
        histogram = histogram.filter(~by_guid | (F.col("batch_guid") == guid))
    return histogram


def anchors_of(histogram: DataFrame) -> DataFrame:
    """``batches.batch_anchor`` from a histogram."""
    return histogram.groupBy(*BATCH_KEYS).agg(trunc_second(F.min("first_created")).alias("job_date"),
                                              F.sum("jobs").cast("long").alias("total_jobs"))


def histogram_counts(histogram: DataFrame, anchors: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """``sla.tier_counts`` from a histogram and the prepared side of its anchors (batch keys and job_date)."""
    timed = (histogram.filter(known_task("task", policy))
             .join(anchors.select(*BATCH_KEYS, "job_date"), list(BATCH_KEYS))
             .withColumn("sla_order", tier_of("task", "done", "job_date", policy)))
    finished = F.col("done").isNotNull()

    def jobs_where(cond, name: str):
        return F.sum(F.when(cond, F.col("jobs")).otherwise(F.lit(0).cast("long"))).cast("long").alias(name)
    return timed.groupBy(*BATCH_KEYS, "job_date").agg(
        F.sum("jobs").cast("long").alias("total_jobs"), jobs_where(~finished, "unfinished_count"),
        *[jobs_where(finished & (F.col("sla_order") == k), f"n{k}") for k in range(1, _max_tiers(policy) + 1)])


class ReportState:
    """A histogram kept as a Parquet table partitioned by creation day, for reports without the job log.

    ``fold`` adds jobs (a new day, or late rows of days already there); ``replace`` puts re-sent days in place of what was
    kept of them. Only partitions of days that the jobs touch are read and written. What is to be written is first
    merged into a table of its own, so a run that fails before the last step leaves the state as it was; the last
    step overwrites the touched days one directory at a time, and ``replace`` can simply be run again.
    Changed rows of the log (a job that has finished since) are re-sent days: give the whole day to ``replace``.
    One writer at a time.
    """

    DAY = "state_day"

    def __init__(self, spark: SparkSession, path: str, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY):
        self.spark, self.path, self.policy = spark, path.rstrip("/"), policy

    def _exists(self) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)

    def histogram(self, days: list[dt.date] | None = None) -> DataFrame:
        """The kept histogram, of all days or (partitions pruned) of some."""
        schema = ("task string, job_day timestamp_ntz, batch_guid string, done timestamp_ntz, jobs bigint, "
                  f"first_created timestamp_ntz, {self.DAY} date")
        if not self._exists():
            return self.spark.createDataFrame([], schema).drop(self.DAY)
        kept = self.spark.read.schema(schema).parquet(self.path)
        if days is not None:
            kept = kept.filter(F.col(self.DAY).isin(days))
        return kept.drop(self.DAY)

    def fold(self, jobs: DataFrame) -> list[dt.date]:
        """Add jobs; returns the days they touch."""
        return self._write(jobs, keep=True)

    def replace(self, jobs: DataFrame) -> list[dt.date]:
        """Put the jobs in place of all that is kept of their days; returns the days."""
        return self._write(jobs, keep=False)

    def _write(self, jobs: DataFrame, keep: bool) -> list[dt.date]:
        new = materialize(batch_histogram(jobs, self.policy))
        days = sorted(r[0] for r in new.select(F.to_date("job_day")).distinct().collect())  # calendar days
        rows = new
        if keep and days:
            rows = merge_histograms(new.unionByName(self.histogram(days)))
        merged = materialize(rows.withColumn(self.DAY, F.to_date("job_day")))
        if days:
            # one file per day unless it is large: the rebalancing splits and joins partitions by their size
            (merged.hint("rebalance", self.DAY).write.mode("overwrite").partitionBy(self.DAY)
             .option("partitionOverwriteMode", "dynamic").parquet(self.path))
        discard(merged)
        discard(new)
        return days
