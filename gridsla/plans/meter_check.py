"""Power state of given meters in given time spans, without a job log.

The spans are an explicit relation (meterid, win_start, win_end): a short list typed in, or any table of
any size. Unlike the tier windows of ``SlaAnalysis`` their bounds may lie at any microsecond, and one meter may have
any number of spans, overlapping or not.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.power import prior_code, prior_opposite_time, prior_time
from ..operators import power as P
from .materialize import broadcast_if_rows, discard, materialize


def spans_of(spark: SparkSession, meterids, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """One span [start, end] for each meter id of a list (ids are taken as text, repeats count once)."""
    rows = [(m,) for m in sorted({str(m) for m in meterids if m is not None})]
    bounds = [F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz").alias(n) for t, n in ((start, "win_start"), (end, "win_end"))]
    return spark.createDataFrame(rows, "meterid string").select("meterid", *bounds)


class MeterCheck:
    """Facts and states of ``spans`` from an alarm log and an import log.

    Spans that are equal count once; a span with a null in it is left out. In a span that ends before it starts nothing
    can happen, so its state follows the alarms before its start. Both ends of a span are inside.

    The logs are read in the spans' range of days only and are filtered by the given meters before any shuffle
    (``operators.power.signal_filter``); earlier alarms reach back as far as the log, by ``alarm_days``
    (``operators.power.alarm_daily_summary``) where that is kept. ``close()`` deletes the written tables.
    """

    def __init__(self, spans: DataFrame, alarms: DataFrame, imports: DataFrame, alarm_days: DataFrame | None = None):
        self.given, self.alarms, self.imports, self.alarm_days = spans, alarms, imports, alarm_days
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(materialize(df))
        return self._kept[-1]

    @cached_property
    def spans(self) -> DataFrame:
        return self._keep(self.given.select(*P.NEED_KEYS).dropna().distinct())

    @cached_property
    def facts(self) -> DataFrame:
        """One row per span: newest power alarms before it, flips and imports in it."""
        first, last = self.spans.agg(F.min("win_start"), F.max(F.greatest("win_start", "win_end"))).first()
        meters = self._keep(self.spans.select("meterid").distinct())
        wanted = P.signal_filter(meters, meters.count())
        alarms, imports = wanted(self.alarms, "meterid"), wanted(self.imports, "meter_id")
        days = self.alarm_days
        if first is not None:
            midnight = dt.datetime.combine(first.date(), dt.time())
            if days is None:  # only days before a span's first day are asked for
                days = P.alarm_daily_summary(P.alarm_history(alarms, dt.datetime.combine(last.date(), dt.time())))
            days = P.fold_days(days, midnight)
            alarms, imports = P.restrict_alarms(alarms, midnight, last), P.restrict_imports(imports, midnight, last)
        fractions = self._keep(P.fraction_seconds(self.spans))
        n = fractions.count()
        return P.power_facts(self.spans, alarms, imports, days, P.NEED_KEYS,
                             broadcast_if_rows(fractions, n) if n else None)

    def report(self) -> DataFrame:
        """The state of every span with the facts it follows from."""
        on, off = F.col("last_on_before"), F.col("last_off_before")
        state = P.state_of(self.facts, ("*",))
        seen = F.col("has_alarm_before")
        return state.select(
            *P.NEED_KEYS,
            F.when(seen, prior_code(on, off)).alias("pre_status_code"),
            F.when(seen, prior_time(on, off)).alias("pre_status_time"),
            F.when(seen, prior_opposite_time(on, off)).alias("pre_opposite_status_time"),
            "flip_count", "latest_state", "latest_event_time",
            F.when(F.col("import_count") > 0, F.lit("Yes")).otherwise(F.lit("No")).alias("import_in_window"),
            "first_import_time", "meter_power_state")

    def close(self) -> None:
        for df in self._kept:
            discard(df)
        self._kept = []


def check_power_off_meters(meterids, start: dt.datetime, end: dt.datetime, alarms: DataFrame, imports: DataFrame,
                           alarm_days: DataFrame | None = None) -> DataFrame:
    """(meterid, meter_power_state) of a list of meters in [start, end], ordered by meterid; an empty list gives no rows."""
    spans = spans_of(alarms.sparkSession, meterids, start, end)
    return MeterCheck(spans, alarms, imports, alarm_days).report().select("meterid", "meter_power_state").orderBy("meterid")
