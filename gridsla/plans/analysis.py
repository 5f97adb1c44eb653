"""One object that wires the operators over a job log, an alarm log and an import log.

Shared intermediates (batched jobs, anchors, timed jobs, meter windows, power
facts) are built once per object and reused by every output. Everything stays
lazy but for two tables written once to the shared folder: the per-batch anchors, so that
their size is known before a broadcast, and (power outputs only) the distinct window rows, which
the branches of a power plan read in place of the job log.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import histogram as H
from ..operators import late as L
from ..operators import listing
from ..operators import meter_sets as M
from ..operators import power as P
from ..operators import rejects
from ..operators import sla as S
from ..operators import split as X
from ..functions.tiers import known_task
from ..sources.policy import DEFAULT_POLICY, TaskPolicy, task_of_code, validate
from .materialize import broadcast_if_rows, discard, materialize


class SlaAnalysis:
    """``histogram`` (``operators.histogram.ReportState.histogram``) stands in for the job log in the report outputs
    (``batch_anchor``, ``sla_report``, ``sla_gap``, ``late_summary``, ``tier_window``, ``unknown_task_report``); ``jobs`` may
    then be None, if no other output is asked for.

    ``signals`` (``operators.signal_state.SignalState``) stands in for both signal logs in every power output but the
    listings of single flips (``power_flips``, ``flip_listing``, ``flip_listing_chunks``), which need the alarm log."""

    def __init__(self, jobs: DataFrame | None, alarms: DataFrame | None = None, imports: DataFrame | None = None,
                 policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY, *,
                 task: str | None = None, day=None, guid: str | None = None, tc: str | None = None,
                 alarm_days: DataFrame | None = None, histogram: DataFrame | None = None, signals=None):
        self.jobs = jobs
        self.alarms = alarms
        self.imports = imports
        self.alarm_days_given = alarm_days
        self.signals = signals
        self.policy = validate(policy)
        if tc is not None:
            task = task_of_code(self.policy, tc, task)
        self.narrow = {"task": task, "day": day, "guid": guid}
        self.keep_power_facts = False
        self._kept: list[DataFrame] = []
        if histogram is not None:
            self.histogram = H.narrow_histogram(histogram, self.policy, **self.narrow)

    # shared intermediates
    @cached_property
    def batched(self) -> DataFrame:
        return B.assign_batches(self.jobs, self.policy, **self.narrow)

    @cached_property
    def all_anchors(self) -> DataFrame:
        """Anchors of every batch, tasks without policy included (one per task and
        day): written once, so the N/A rows cost no second job-log scan. From the histogram if there is one."""
        if "histogram" in self.__dict__:
            return self._keep(H.anchors_of(self.histogram))
        every = B.assign_batches(self.jobs, self.policy, include_unknown=True, **self.narrow)
        return self._keep(B.batch_anchor(every))

    @cached_property
    def histogram(self) -> DataFrame:
        """Jobs per batch and completion second, written once: the report's only scan of the job log."""
        return self._keep(H.batch_histogram(self.jobs, self.policy, **self.narrow))

    @cached_property
    def counts(self) -> DataFrame:
        """Per batch the jobs by tier, read off the histogram."""
        histogram = self.histogram  # before the anchors, which then come from it
        return H.histogram_counts(histogram, self.anchor_side, self.policy)

    @cached_property
    def anchors(self) -> DataFrame:
        return self.all_anchors.filter(known_task("task", self.policy))

    @cached_property
    def anchor_stats(self):
        """One small aggregate over the materialised anchors: the batch count (the
        broadcast checks) and the first and last anchor (the scan range)."""
        return self.anchors.agg(F.count(F.lit(1)).alias("batches"), F.min("job_date").alias("first"),
                                F.max("job_date").alias("last")).first()

    @cached_property
    def anchor_side(self) -> DataFrame:
        return broadcast_if_rows(self.anchors, self.anchor_stats.batches)

    @cached_property
    def timed(self) -> DataFrame:
        return B.timed_jobs(self.batched, self.policy, self.anchor_side)

    @cached_property
    def late(self) -> DataFrame:
        return L.late_jobs(self.timed, self.policy)

    @cached_property
    def meters(self) -> DataFrame:
        return S.meters_by_tier(self.timed, self.policy)

    @cached_property
    def windowed(self) -> DataFrame:
        """Distinct (batch, tier, meter) rows with their window: written once, since the
        earlier-days pass and the in-window pass both read them several times."""
        return self._keep(S.with_window(self.meters, self.anchor_side, self.policy))

    @cached_property
    def needs(self) -> DataFrame:
        return P.needs_of(self.windowed)

    @cached_property
    def _longest(self) -> int:
        return max(p.max_limit for p in self.policy)

    @cached_property
    def bounds(self):
        """(first window day, midnight of the last window end's day, last window end) or None."""
        st = self.anchor_stats
        if not st.batches:
            return None
        last = st.last + dt.timedelta(minutes=self._longest)
        return (dt.datetime.combine(st.first.date(), dt.time()),
                dt.datetime.combine(last.date(), dt.time()), last)

    @cached_property
    def wanted(self):
        """The filter of signals by meter, from the counted distinct meters of the window rows."""
        meters = self._keep(self.windowed.select("meterid").distinct())
        return P.signal_filter(meters, meters.count())

    @cached_property
    def window_alarms(self) -> DataFrame:
        b = self.bounds
        alarms = self.wanted(self._given(self.alarms, "alarm"), "meterid")
        return alarms if b is None else P.restrict_alarms(alarms, b[0], b[2])

    @cached_property
    def window_imports(self) -> DataFrame:
        b = self.bounds
        imports = self.wanted(self._given(self.imports, "import"), "meter_id")
        return imports if b is None else P.restrict_imports(imports, b[0], b[2])

    @cached_property
    def alarm_days(self) -> DataFrame:
        b = self.bounds
        if self.alarm_days_given is not None:
            daily = self.alarm_days_given
        elif self.signals is not None:
            daily = self.wanted(self.signals.alarm_days(None if b is None else b[1].date()), "meterid")
        else:
            # the earlier-days pass reads only days before a window's start day
            alarms = self.wanted(self._given(self.alarms, "alarm"), "meterid")
            daily = P.alarm_daily_summary(alarms if b is None else P.alarm_history(alarms, b[1]))
        return daily if b is None else P.fold_days(daily, b[0])

    @cached_property
    def kept_slots(self) -> DataFrame:
        """The kept slots of the wanted meters on the days that windows touch."""
        b = self.bounds
        first, last = (None, None) if b is None else (b[0].date(), b[2].date())
        return self.wanted(self.signals.slots(first, last), "meterid")

    @cached_property
    def facts(self) -> DataFrame:
        if self.signals is not None:
            facts = P.facts_of_slots(self.windowed, self.kept_slots, self.alarm_days, deal=self.signals.dealt)
        else:
            facts = P.power_facts(self.windowed, self.window_alarms, self.window_imports, self.alarm_days)
        return self._keep(facts) if self.keep_power_facts else facts

    @cached_property
    def prior(self) -> DataFrame:
        if self.keep_power_facts or self.signals is not None:
            return P.prior_of(self.facts)
        return P.prior_facts(self.windowed, self.window_alarms, self.alarm_days)

    @cached_property
    def flips_inside(self) -> DataFrame:
        if self.keep_power_facts or self.signals is not None:
            return P.flips_of(self.facts)
        return P.window_facts(self.windowed, self.window_alarms, None)

    @cached_property
    def imports_inside(self) -> DataFrame:
        if self.keep_power_facts or self.signals is not None:
            return P.imports_of(self.facts)
        return P.window_facts(self.windowed, None, self.window_imports)

    @cached_property
    def states(self) -> DataFrame:
        return P.meter_power_state(self.facts)

    @cached_property
    def split(self) -> DataFrame:
        return X.power_split(self.states)

    @staticmethod
    def _given(log: DataFrame | None, name: str) -> DataFrame:
        if log is None:
            raise ValueError(f"this output needs the {name} log")
        return log

    def _keep(self, df: DataFrame) -> DataFrame:
        kept = materialize(df)
        self._kept.append(kept)
        return kept

    def close(self) -> None:
        """Delete the tables this object has written; its outputs cannot be read afterwards."""
        for df in self._kept:
            discard(df)
        self._kept = []

    def has_batches(self) -> bool:
        """False when no batch matches (the "no records" case); reads the small
        materialised anchor table only."""
        return not self.anchors.isEmpty()

    # A1-A25
    def oldest_open_guid(self):
        return B.oldest_open_guid(self.jobs, self.narrow["task"], self.narrow["day"], keep=self._keep)

    def batch_anchor(self):
        return self.anchors

    def job_durations(self):
        return B.job_durations(self.jobs, self.policy, **self.narrow)

    def sla_report(self, with_unknown: bool = True):
        return S.sla_report(self.counts, self.policy, self.unknown_task_report() if with_unknown else None)

    def sla_gap(self):
        return S.sla_gap(self.counts, self.policy)

    def late_jobs(self):
        return self.late

    def late_job_sample(self, n: int = L.DEFAULT_SAMPLE, seed: int = 0):
        return L.late_job_sample(self.late, n, seed)

    def late_summary(self):
        return L.late_summary(self.counts, self.policy)

    def tier_of_job(self):
        return S.tier_of_job(self.timed, self.policy)

    def meters_by_tier(self):
        return self.meters

    @cached_property
    def dictionary(self) -> DataFrame:
        kept = M.meter_dictionary(self.batched)
        self._kept.append(kept)
        return kept

    @cached_property
    def tier_sets(self) -> DataFrame:
        """The meters of each batch and tier as blocks of bits over ``dictionary``."""
        return M.tier_sets(self.timed, self.dictionary)

    def tier_overlaps(self):
        return M.tier_overlaps(self.tier_sets, self.policy)

    def tier_window(self):
        return S.tier_window(self.anchors, self.policy)

    def power_status_before(self):
        return P.power_status_before(self.prior)

    def prior_power_code(self):
        return P.prior_power_code(self.prior)

    def power_flips(self):
        return P.power_flips(self.needs, self.window_alarms)

    def flip_counts(self):
        return P.flip_counts(self.flips_inside)

    def flip_listing(self):
        return P.flip_listing(self.needs, self.window_alarms)

    def flip_listing_chunks(self, size: int = listing.DEFAULT_CHUNK):
        return listing.flip_listing_chunks(self.needs, self.window_alarms, size)

    def reject_counts(self):
        logs = {"jobs": self.jobs, "alarms": self.alarms, "imports": self.imports}
        return rejects.reject_counts({k: v for k, v in logs.items() if v is not None}, self.policy)

    def rejected(self, log: str):
        """The rows of "jobs", "alarms" or "imports" that no output holds, with the reason."""
        return rejects.rejected(self._given(getattr(self, log), log), log, self.policy)

    def latest_flip(self):
        return P.latest_flip(self.flips_inside)

    def import_presence(self):
        return P.import_presence(self.imports_inside)

    def meter_power_state(self):
        return self.states

    def power_split(self):
        return self.split

    def power_summary(self):
        return X.power_summary(self.split)

    def powered_off_list(self):
        return X.powered_off_list(self.split)

    def eligible_list(self):
        return X.eligible_list(self.split)

    def late_job_export(self):
        return L.late_job_export(self.late, self.states)

    def unknown_task_report(self, with_time: bool = True):
        """The N/A row of each task without policy and day; a task asked for gets one whatever the log holds."""
        unknown = self.all_anchors.filter(~known_task("task", self.policy)).select("task", "job_day")
        task, day = self.narrow["task"], self.narrow["day"]
        if task is not None and task not in {p.task for p in self.policy}:
            asked = unknown.sparkSession.createDataFrame([(task, None if day is None else str(day))], "task string, d string")
            asked = asked.select("task", F.to_date("d").cast("timestamp_ntz").alias("job_day"))
            unknown = unknown.unionByName(asked.join(unknown, "task", "left_anti"))
        return S.na_rows(unknown, with_time)

    # every output in one run
    OUTPUTS = ("oldest_open_guid", "batch_anchor", "job_durations", "sla_report", "sla_gap", "late_jobs",
               "late_job_sample", "late_summary", "tier_of_job", "meters_by_tier", "tier_window",
               "power_status_before", "prior_power_code", "power_flips", "flip_counts", "flip_listing",
               "latest_flip", "import_presence", "meter_power_state", "power_split", "power_summary",
               "powered_off_list", "eligible_list", "late_job_export", "unknown_task_report")
    CSV_OUTPUTS = ("powered_off_list", "late_job_export")
    # large outputs that a user reads in order: their files are sorted one after the other
    SORTED_OUTPUTS = {"meters_by_tier": (*B.BATCH_KEYS, "sla_order", "meterid"),
                      "meter_power_state": (*B.BATCH_KEYS, "sla_order", "meterid"),
                      "flip_listing": ("meterid", "win_start", "win_end", "alarm_date", "state")}

    def write_outputs(self, root: str, names: tuple[str, ...] | None = None, fmt: str = "parquet") -> dict[str, str]:
        """Write the chosen outputs under ``root`` (CSV with header for the two exports).

        The per-window power facts feed eleven outputs; when more than one of them is asked for (and both
        signal logs are given) they are written once to the shared folder instead of recomputed per output.
        Returns name -> path.
        """
        from ..sources.sinks import write_csv, write_sorted
        names = self.OUTPUTS if names is None else names
        unknown = set(names) - set(self.OUTPUTS)
        if unknown:
            raise ValueError(f"unknown outputs {sorted(unknown)}")
        power = {"power_status_before", "prior_power_code", "flip_counts", "latest_flip", "import_presence",
                 "meter_power_state", "power_split", "power_summary", "powered_off_list", "eligible_list",
                 "late_job_export"}
        both = self.signals is not None or (self.alarms is not None and self.imports is not None)
        if both and len(power & set(names)) > 1 and "facts" not in self.__dict__:
            self.keep_power_facts = True
        if {"sla_report", "sla_gap", "late_summary"} & set(names):
            self.histogram  # before the anchors, which then need no scan of their own
        paths = {}
        for name in names:
            path = f"{root.rstrip('/')}/{name}"
            df = getattr(self, name)()
            if name in self.CSV_OUTPUTS:
                write_csv(df, path)
            elif name in self.SORTED_OUTPUTS:
                write_sorted(df, path, self.SORTED_OUTPUTS[name], fmt)
            else:
                df.write.mode("overwrite").format(fmt).save(path)
            paths[name] = path
        return paths

