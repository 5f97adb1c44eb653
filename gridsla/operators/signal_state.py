"""Alarms and imports kept as signal slots, laid out by day and bucketed by (meter, day).

A log laid out by meter alone would make a meter with a third of all signals one task. The table kept here holds
the slots of ``power.signal_slots`` instead of signals: a meter's day is at most 172,800 rows whatever the number of
its signals, a meter's days lie in different buckets, and slots of one key merge by sum, maximum and minimum. A
reader takes the partitions of the days it needs, and sorts slots and window bounds of a (meter, day) without a
shuffle of the slots: only the bounds are sent to the buckets.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import discard, materialize
from .power import signal_slots

DEFAULT_BUCKETS = 200
SLOT_KEYS = ("meterid", "day", "p")
_SLOT_SCHEMA = ("meterid string, day date, p bigint, on_t timestamp_ntz, off_t timestamp_ntz, n_alarms bigint, "
                "n_flips bigint, newest_key bigint, flip_t timestamp_ntz, n_imports bigint, import_t timestamp_ntz")


def merge_slots(slots: DataFrame) -> DataFrame:
    """Slots of any number of parts of the logs, merged."""
    newest = ("on_t", "off_t", "newest_key", "flip_t")
    counts = ("n_alarms", "n_flips", "n_imports")
    merged = slots.groupBy(*SLOT_KEYS).agg(
        *[F.max(c).alias(c) for c in newest], *[F.sum(c).cast("long").alias(c) for c in counts],
        F.min("import_t").alias("import_t"))
    return merged.select(*[f.split()[0] for f in _SLOT_SCHEMA.split(", ")])


class SignalState:
    """Slots kept as a table in ``path``, partitioned by day and bucketed by (meterid, day).

    ``fold`` adds alarms and imports (a new day, or late rows of days already there); ``replace`` puts re-sent days in
    place of what was kept of them (give both logs of those days). Only partitions of days that the rows touch are read
    and written, and what is to be written is first merged into a table of its own. One writer at a time. Signals without a
    time or a meter are left out, as in every output.

    Windows have to begin and end on whole seconds, as those of the tiers do (``plans.meter_check`` reads the logs).
    The number of ``buckets`` is fixed when the table is made; a later session finds it in the folder's name.
    """

    DAY = "state_day"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        there = next((int(n[3:]) for n in names if n.startswith("by_")), None)
        if there and buckets not in (None, there):
            raise ValueError(f"{self.path} has {there} buckets, not {buckets}")
        self.buckets = there or buckets or DEFAULT_BUCKETS
        location = f"{self.path}/by_{self.buckets}"
        fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location))
        self.table = f"gridsla_signals_{hashlib.md5(location.encode()).hexdigest()}"
        quoted = location.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({_SLOT_SCHEMA}, {self.DAY} date) USING parquet "
                  f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({self.DAY}) "
                  f"CLUSTERED BY (meterid, day) INTO {self.buckets} BUCKETS LOCATION '{quoted}'")
        spark.catalog.recoverPartitions(self.table)

    def slots(self, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """The kept slots, of all days or (partitions pruned) of those from ``first`` to ``last``."""
        kept = self.spark.table(self.table)
        if first is not None:
            kept = kept.filter(F.col(self.DAY) >= F.lit(first))
        if last is not None:
            kept = kept.filter(F.col(self.DAY) <= F.lit(last))
        return kept.drop(self.DAY)

    def alarm_days(self, before: dt.date | None = None) -> DataFrame:
        """``power.alarm_daily_summary`` of the kept alarms, of all days or those before a day: no shuffle."""
        last = None if before is None else before - dt.timedelta(days=1)
        return (self.slots(last=last).filter(F.col("n_alarms") > 0).groupBy("meterid", "day")
                .agg(F.max("on_t").alias("on_t"), F.max("off_t").alias("off_t"), F.sum("n_alarms").alias("n")))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with (meterid, day) sent to where the slots of that meter and day lie."""
        return rows.repartition(self.buckets, "meterid", "day")

    def fold(self, alarms: DataFrame | None, imports: DataFrame | None) -> list[dt.date]:
        """Add signals; returns the days they touch."""
        return self._write(alarms, imports, keep=True)

    def replace(self, alarms: DataFrame | None, imports: DataFrame | None) -> list[dt.date]:
        """Put the signals in place of all that is kept of their days; returns the days."""
        return self._write(alarms, imports, keep=False)

    def _write(self, alarms, imports, keep: bool) -> list[dt.date]:
        new = materialize(signal_slots(alarms, imports))
        days = sorted(r[0] for r in new.select("day").distinct().collect())  # calendar days
        merged = new
        if keep and days:
            old = self.spark.table(self.table).filter(F.col(self.DAY).isin(days)).drop(self.DAY)
            merged = materialize(merge_slots(self.dealt(new.select(old.columns)).unionByName(old)))
        if days:
            columns = self.spark.table(self.table).columns
            self.dealt(merged.withColumn(self.DAY, F.col("day"))).select(columns).write.insertInto(self.table, overwrite=True)
        for done in {id(x): x for x in (new, merged)}.values():
            discard(done)
        return days
