"""The job log, alarm log and import log as views derived from an ``events`` table.

The test tables carry no smart-meter data, so the three inputs are derived from
``events`` (event_id, ts, user_id, event_type, value, props) by fixed formulas.
Everything is a projection or a filter of the one scan, so pushdown and pruning
reach the parquet reader. The arithmetic on ``value`` is integral (whole
milliseconds) so every engine computes the same instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation: task per event_id % 4, the completion-time
# multiplier per task, and the alarm name per event type.
TASK_BY_MOD4 = ("Alert / Tamper", "Instant,Load Survey,", "serviceFirmwareUpdate", "serviceSetLoadLimit")
DURATION_MULTIPLIER = (1, 2, 6, 12)
ALARM_BY_EVENT = {"error": "METER_LAST_GASP", "signup": "METER_FIRST_BREATH", "click": "COVER_OPEN"}
IMPORT_EVENTS = ("view", "purchase")
UNFINISHED_EVERY = 97  # event_id % 97 == 0 -> job never completed
UNLISTED_EVERY, UNLISTED_TASK = 101, "meterDiagnostics"  # event_id % 101 == 0 -> a task without policy
NO_GUID_EVERY = 89     # event_id % 89 == 0 -> no guid
# alarm names of two more kinds of alarm rows: both events in one text, and a name that only the LIKE wildcard finds
BOTH_EVERY, BOTH_NAMES = 53, "METER_LAST_GASP,METER_FIRST_BREATH"
WILDCARD_EVERY, WILDCARD_NAMES = 59, "COVER_OPEN,METER-LAST GASP"


def _pick(index: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def _meter(user_id: Column) -> Column:
    return F.concat(F.lit("M"), user_id.cast("string"))


def jobs_from_events(events: DataFrame) -> DataFrame:
    mod4 = F.col("event_id") % 4
    midnight = F.to_date("ts").cast("timestamp_ntz")
    created = F.timestamp_add("MILLISECOND", (F.col("event_id") % 120) * 1000 + 250, midnight)
    step_ms = F.round(F.col("value") * 100).cast("long") * 600 * _pick(mod4, DURATION_MULTIPLIER)
    return events.select(
        F.col("event_id").alias("job_id"),
        F.when(F.col("event_id") % UNLISTED_EVERY == 0, UNLISTED_TASK).otherwise(_pick(mod4, TASK_BY_MOD4)).alias("task"),
        F.when(F.col("event_id") % NO_GUID_EVERY != 0,
               F.concat(F.lit("G"), (F.col("user_id") % 2).cast("string"))).alias("guid"),
        F.when(F.col("event_type") == "error", F.lit("0")).otherwise(F.lit("1")).alias("status"),
        _meter(F.col("user_id")).alias("meterid"),
        created.alias("createddate"),
    F.when(F.col("event_id") % UNFINISHED_EVERY == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.timestamp_add("MILLISECOND", step_ms, created)).alias("completiondatetime"),
    )


def alarms_from_events(events: DataFrame) -> DataFrame:
    name = (F.when(F.col("event_id") % BOTH_EVERY == 0, F.lit(BOTH_NAMES))
            .when(F.col("event_id") % WILDCARD_EVERY == 0, F.lit(WILDCARD_NAMES)))
    for ev, alarm in ALARM_BY_EVENT.items():
        name = name.when(F.col("event_type") == ev, F.lit(alarm))
    return (events.filter(F.col("event_type").isin(list(ALARM_BY_EVENT)))
            .select(_meter(F.col("user_id")).alias("meterid"),
                    F.col("ts").alias("alarm_date"),
                    name.alias("alarm_names")))


def imports_from_events(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("event_type").isin(list(IMPORT_EVENTS)))
            .select(_meter(F.col("user_id")).alias("meter_id"), F.col("ts").alias("das_rtc")))


SPAN_TASK = "serviceSetLoadLimit"


def job_spans(jobs: DataFrame) -> DataFrame:
    """One (meterid, win_start, win_end) per finished job of a task: from its creation to its completion, at
    milliseconds; a list of meters and times to check."""
    return jobs.filter((F.col("task") == SPAN_TASK) & F.col("completiondatetime").isNotNull()).select(
        "meterid", F.col("createddate").alias("win_start"), F.col("completiondatetime").alias("win_end"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def load_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, alarms, imports) derived from ``{sf_dir}/events.parquet``."""
    ev = read_events(spark, sf_dir)
    return jobs_from_events(ev), alarms_from_events(ev), imports_from_events(ev)
