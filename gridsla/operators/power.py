"""Meter power state per tier window: A12-A19.

Input: the meters of each batch tier with the tier's window [win_start, win_end]
(``sla.with_window``), one "windowed" row per (batch, tier, meter). A "need" is
one distinct (meterid, win_start, win_end).

Plan shape:

* Signals of meters that no window asks for are filtered out in the scan stage, before any shuffle
  (``signal_filter``: a broadcast semi join behind a count, beyond it a broadcast Bloom filter).
* Signals are summarised per (meter, day, position) by a partial aggregate. A position is one whole second's
  instant or the open gap after it, so a hot meter-day shrinks to at most 172,800 rows on a map task; only
  seconds in which a window begins or ends at a fraction keep their microseconds (``signal_slots``).
* A window is not paired with its slots. Slots and window bounds are sorted together per (meter, day); running counts
  and running newest times are read at the two bounds and their differences are the window's facts
  (``_bound_contributions``): slots + windows rows, whatever the windows' lengths.
* Alarms on earlier days: a summary per (meter, day) of the wanted meters, with all days before
  the first window in one row, and a running maximum per meter over that and its distinct start days
  (``_earlier_days``): at most the days of the windows' range plus one.
* Both parts are unioned and aggregated once per windowed row; the state is computed on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.power import (flip_state, flip_text, names_power_off, names_power_on,
                               power_state, prior_code, prior_opposite_time, prior_time)
from ..functions.timecols import day_of, micros_between
from ..plans.materialize import broadcast_row_limit
from .batches import BATCH_KEYS

NEED_KEYS = ("meterid", "win_start", "win_end")
WINDOW_KEYS = (*BATCH_KEYS, "sla_tier", "sla_order", *NEED_KEYS)
EPOCH = "1970-01-01 00:00:00"


def needs_of(windowed: DataFrame) -> DataFrame:
    """Distinct (meterid, win_start, win_end) over all batch tiers."""
    return windowed.select(*NEED_KEYS).distinct()


START_KEYS = ("meterid", "win_start")


def _signals(alarms: DataFrame | None, imports: DataFrame | None) -> DataFrame:
    """The given logs as one relation: (meterid, day, t, is_alarm, is_on, is_off)."""
    parts = []
    if alarms is not None:
        parts.append(alarms.select(
            F.col("meterid"), F.col("alarm_date").alias("t"), F.lit(True).alias("is_alarm"),
            F.coalesce(names_power_on(F.col("alarm_names")), F.lit(False)).alias("is_on"),
            F.coalesce(names_power_off(F.col("alarm_names")), F.lit(False)).alias("is_off")))
    if imports is not None:
        parts.append(imports.select(
            F.col("meter_id").alias("meterid"), F.col("das_rtc").alias("t"), F.lit(False).alias("is_alarm"),
            F.lit(False).alias("is_on"), F.lit(False).alias("is_off")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.filter(F.col("t").isNotNull()).withColumn("day", day_of(F.col("t")))


def power_alarms(alarms: DataFrame) -> DataFrame:
    """Alarms that name a power event (a filter on the scan, before any shuffle)."""
    return alarms.filter(names_power_on(F.col("alarm_names")) | names_power_off(F.col("alarm_names")))


def _window_days(rows: DataFrame, keys) -> DataFrame:
    """Each row once per calendar day its window touches (a window spans few days; one that ends before
    it starts touches its start's day)."""
    days = F.sequence(day_of(F.col("win_start")), day_of(F.greatest("win_start", "win_end")))
    cols = list(dict.fromkeys([*keys, "win_start", "win_end"]))
    return rows.select(*cols, F.explode(days).alias("day"))


def power_flips(needs: DataFrame, alarms: DataFrame) -> DataFrame:
    """Power alarms inside each window, state 1 = power on (also when both are named)."""
    t = F.col("t")
    return (_signals(power_alarms(alarms), None).join(_window_days(needs, NEED_KEYS), ["meterid", "day"])
            .filter((t >= F.col("win_start")) & (t <= F.col("win_end")))
            .select(*NEED_KEYS, t.alias("alarm_date"), flip_state(F.col("is_on")).alias("state")))


def flip_listing(needs: DataFrame, alarms: DataFrame) -> DataFrame:
    """The listing entries 'METER_FIRST_BREATH @ dd-MM-yyyy HH:mm:ss' / 'METER_LAST_GASP @ ...'
    of each window, one row per flip (sort by alarm_date descending to read it newest first)."""
    flips = power_flips(needs, alarms)
    return flips.select(*NEED_KEYS, "state", "alarm_date",
                        flip_text(F.col("state"), F.col("alarm_date")).alias("flip_text"))


# Every fact is an aggregate of per-row contributions; these are their columns.
_TS = "timestamp_ntz"
_CONTRIBUTIONS = (("on_before", _TS), ("off_before", _TS), ("alarms_before", "long"), ("flips", "long"),
                  ("newest_key", "long"), ("flip_t", _TS), ("imports", "long"), ("import_t", _TS))


def _markers(rows: DataFrame, keys, **given) -> DataFrame:
    """One contribution row per key with nothing in it (or the ``given`` columns)."""
    return rows.select(*keys, *[given.get(c, F.lit(None).cast(t)).alias(c) for c, t in _CONTRIBUTIONS])


# A Bloom filter of one 64-bit word a meter: keys a word holds on average, and hash functions.
BLOOM_KEYS_PER_WORD = 6
BLOOM_BITS = 4


def bloom_words(meters: DataFrame, words: int) -> DataFrame:
    """A Bloom filter of the ``meterid`` values: (word, bits), at most ``words`` rows."""
    return (meters.select(_bloom_word(F.col("meterid"), words).alias("word"), _bloom_mask(F.col("meterid")).alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("bits")))


def _bloom_word(meter: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(meter), F.lit(words))


def _bloom_mask(meter: Column) -> Column:
    h = F.xxhash64(meter, F.lit("mask"))
    mask = None
    for k in range(BLOOM_BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def signal_filter(meters: DataFrame, count: int, max_rows: int | None = None):
    """A function (log, meter column) -> log without most or all rows of other meters.

    ``meters`` holds the ``count`` distinct wanted ``meterid`` values (a written table). Up to ``max_rows`` of them
    (default: the broadcast bound) are broadcast in a semi join, which is exact. Beyond it a Bloom filter of
    at most ``max_rows`` words is broadcast: it lets through every wanted meter and some others, which no window
    meets later. With so many meters that the filter would be full the log is returned as it is.
    """
    limit = broadcast_row_limit(meters.sparkSession) if max_rows is None else max_rows
    if count <= limit:
        small = F.broadcast(meters.select(F.col("meterid").alias("_wanted")))
        return lambda log, column: log.join(small, F.col(column) == F.col("_wanted"), "left_semi")
    if count > limit * BLOOM_KEYS_PER_WORD * 4:
        return lambda log, column: log
    words = min(limit, count // BLOOM_KEYS_PER_WORD + 1)
    bloom = F.broadcast(bloom_words(meters, words).select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))

    def passes(log: DataFrame, column: str) -> DataFrame:
        mask = _bloom_mask(F.col(column))
        return log.join(bloom, (_bloom_word(F.col(column), words) == F.col("_word"))
                        & (F.col("_bits").bitwiseAND(mask) == mask), "left_semi")
    return passes


def _micros(t: Column) -> Column:
    return micros_between(F.lit(EPOCH).cast(_TS), t)


MICROS, DAY_MICROS = 1_000_000, 86_400_000_000


def slot_of(t: Column) -> Column:
    """The position of ``t`` in microseconds, with everything after a second's instant at its first
    microsecond: for a whole-second bound b, t < b, t = b and t > b are the same comparisons of positions."""
    micros = _micros(t)
    return micros - F.pmod(micros, F.lit(MICROS)) + F.when(F.pmod(micros, F.lit(MICROS)) > 0, 1).otherwise(0)


def fraction_seconds(spans: DataFrame) -> DataFrame:
    """The distinct (meterid, second) in which a window begins or ends at a fraction of the second."""
    bounds = spans.select("meterid", F.explode(F.array(_micros(F.col("win_start")), _micros(F.col("win_end")))).alias("b"))
    return (bounds.filter(F.pmod("b", F.lit(MICROS)) > 0)
            .select("meterid", (F.col("b") - F.pmod("b", F.lit(MICROS))).alias("second")).distinct())


def signal_slots(alarms: DataFrame | None, imports: DataFrame | None, fractions: DataFrame | None = None) -> DataFrame:
    """Signals summarised per (meterid, day, position) by a partial aggregate.

    ``fractions`` (``fraction_seconds``; broadcast by the caller where its size allows) names the seconds whose
    signals keep their microseconds. Signals without a meter are left out.
    """
    t, alarm = F.col("t"), F.col("is_alarm")
    power = F.col("is_on") | F.col("is_off")
    # newest flip as one long, 2 * micros + (1 - state): its max is the newest
    # time and, on a tie of times, the power-off (state 0); a plain max keeps
    # the aggregate a hash aggregate.
    key = _micros(t) * 2 + (1 - flip_state(F.col("is_on")))
    signals = _signals(alarms, imports).filter(F.col("meterid").isNotNull())
    if fractions is None:
        signals = signals.withColumn("p", slot_of(t))
    else:
        exact = fractions.select("meterid", "second", F.lit(True).alias("exact"))
        signals = (signals.withColumn("second", _micros(t) - F.pmod(_micros(t), F.lit(MICROS)))
                   .join(exact, ["meterid", "second"], "left")
                   .withColumn("p", F.when(F.col("exact"), _micros(t)).otherwise(slot_of(t))))
    return signals.groupBy("meterid", "day", "p").agg(
        F.max(F.when(F.col("is_on"), t)).alias("on_t"),
        F.max(F.when(F.col("is_off"), t)).alias("off_t"),
        F.count_if(alarm).alias("n_alarms"),
        F.count_if(power).alias("n_flips"),
        F.max(F.when(power, key)).alias("newest_key"),
        F.max(F.when(power, t)).alias("flip_t"),
        F.count_if(~alarm).alias("n_imports"),
        F.min(F.when(~alarm, t)).alias("import_t"))


_SLOT_COLUMNS = ("on_t", "off_t", "n_alarms", "n_flips", "newest_key", "flip_t", "n_imports", "import_t")


def _bound_contributions(rows: DataFrame, keys, slots: DataFrame, deal=None) -> DataFrame:
    """Contributions of the slot summaries to each row's window, read at its bounds.

    Per day that a window touches there are two bounds: where it begins (before the slots of that position) and
    where it ends (after them). Slots and bounds of a (meter, day) are sorted together; counts up to the end minus counts
    up to the beginning are those of the window, the newest flip up to the end is the window's if it has
    any, and so is the next import after the beginning. What comes before the beginning on the start's day is
    the running value there. ``deal`` (``signal_state.SignalState.dealt``) sends the bounds to slots that
    already lie by (meter, day); the bounds come first in the union, as Spark keeps its children's partitioning by the
    first child's attributes and does not match those of a table scan.
    """
    begin, end = _micros(F.col("win_start")), _micros(F.col("win_end"))
    midnight = _micros(F.col("day").cast(_TS))
    side = F.explode(F.array(
        F.struct(F.greatest(begin, midnight).alias("p"), F.lit(-1).alias("side")),
        F.struct(F.least(end, midnight + F.lit(DAY_MICROS - 1)).alias("p"), F.lit(1).alias("side")))).alias("bound")
    days = _window_days(rows, keys)
    span = [*dict.fromkeys([*keys, "win_start", "win_end"])]
    bounds = days.select(*span, "day", side).select(
        *span, "day", "bound.p", "bound.side",
        *[F.lit(None).cast(slots.schema[c].dataType).alias(c) for c in _SLOT_COLUMNS])
    bounds = bounds if deal is None else deal(bounds)
    facts = slots.select(*[F.col("meterid") if c == "meterid" else F.lit(None).cast(days.schema[c].dataType).alias(c)
                           for c in span], "day", "p", F.lit(0).alias("side"), *_SLOT_COLUMNS)
    order = Window.partitionBy("meterid", "day").orderBy("p", "side")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = bounds.unionByName(facts).select(
        *span, "day", "side",
        *[F.max(c).over(upto).alias(c) for c in ("on_t", "off_t", "newest_key", "flip_t")],
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("long").alias(c) for c in ("n_alarms", "n_flips", "n_imports")],
        F.expr("lead(import_t) IGNORE NULLS OVER (PARTITION BY meterid, day ORDER BY p, side)").alias("next_import"))
    starts, ends = F.col("side") < 0, F.col("side") > 0
    before = starts & (F.col("day") == day_of(F.col("win_start")))
    proper = F.col("win_end") >= F.col("win_start")
    zero = F.lit(0).cast("long")
    sign = F.when(proper, F.col("side")).otherwise(0).cast("long")
    return running.filter(F.col("side") != 0).select(
        *keys,
        F.when(before, F.col("on_t")).alias("on_before"),
        F.when(before, F.col("off_t")).alias("off_before"),
        F.when(before, F.col("n_alarms")).otherwise(zero).alias("alarms_before"),
        (F.col("n_flips") * sign).alias("flips"),
        F.when(ends, F.col("newest_key")).alias("newest_key"),
        F.when(ends, F.col("flip_t")).alias("flip_t"),
        (F.col("n_imports") * sign).alias("imports"),
        F.when(starts, F.col("next_import")).alias("import_t"))


def alarm_daily_summary(alarms: DataFrame) -> DataFrame:
    """Per (meterid, day): newest power-on and power-off alarm time and the alarm count.

    A partial aggregate. Alarms only grow, so a cluster can keep this table and
    append each new day instead of re-reading the whole history every run
    (pass it as ``alarm_days``).
    """
    return (alarms.filter(F.col("alarm_date").isNotNull())
            .groupBy("meterid", day_of(F.col("alarm_date")).alias("day"))
            .agg(F.max(F.when(names_power_on(F.col("alarm_names")), F.col("alarm_date"))).alias("on_t"),
                 F.max(F.when(names_power_off(F.col("alarm_names")), F.col("alarm_date"))).alias("off_t"),
                 F.count(F.lit(1)).alias("n")))


def merge_alarm_daily_summary(summary: DataFrame, new_alarms: DataFrame) -> DataFrame:
    """Fold newly arrived alarms into a kept ``alarm_daily_summary`` table.

    Newest times take the max and counts add, so re-summarising a day that is
    already present (late alarms) stays exact. One partial aggregate over the
    kept table plus the new rows.
    """
    fresh = alarm_daily_summary(new_alarms)
    return (summary.unionByName(fresh).groupBy("meterid", "day")
            .agg(F.max("on_t").alias("on_t"), F.max("off_t").alias("off_t"), F.sum("n").alias("n")))


def fold_days(summary: DataFrame, first_day) -> DataFrame:
    """A daily summary with all days before ``first_day`` (a datetime) in one row per meter."""
    floor = _ntz(first_day) - F.expr("INTERVAL 1 DAY")
    return summary.groupBy("meterid", F.greatest("day", floor).alias("day")).agg(
        F.max("on_t").alias("on_t"), F.max("off_t").alias("off_t"), F.sum("n").alias("n"))


def _earlier_days(rows: DataFrame, keys, alarm_days: DataFrame) -> DataFrame:
    """Per row: newest on/off alarm and alarm count on days before the start's day.

    All windows of a meter that start on one day share the answer, so the running maximum goes
    over the meter's distinct start days and its daily summary (of wanted meters only), and is
    joined back on (meterid, day). Yields exactly one row per input row.
    """
    dated = rows.withColumn("day", day_of(F.col("win_start")))
    wanted = dated.select("meterid", "day").distinct()
    none = F.lit(None).cast(_TS)
    daily = alarm_days.join(wanted.select("meterid").distinct(), "meterid", "left_semi").select(
        "meterid", "day", F.lit(1).alias("kind"), "on_t", "off_t", "n")
    starts = wanted.select("meterid", "day", F.lit(0).alias("kind"), none.alias("on_t"), none.alias("off_t"),
                           F.lit(0).cast("long").alias("n"))
    w = Window.partitionBy("meterid").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (starts.unionByName(daily)
               .select("meterid", "day", "kind", F.max("on_t").over(w).alias("on_t"),
                       F.max("off_t").over(w).alias("off_t"), F.sum("n").over(w).alias("n"))
               .filter(F.col("kind") == 0).drop("kind"))
    return _markers(dated.join(running, ["meterid", "day"], "left"), keys, on_before=F.col("on_t"),
                    off_before=F.col("off_t"), alarms_before=F.col("n"))


def _aggregate(contributions: DataFrame, keys) -> DataFrame:
    """Facts per row. Newest flip and first import are the window's only where it has any (``_bound_contributions``)."""
    flipped, imported = F.col("flip_count") > 0, F.col("import_count") > 0
    return (contributions.groupBy(*keys).agg(
        F.max("on_before").alias("last_on_before"),
        F.max("off_before").alias("last_off_before"),
        (F.coalesce(F.sum("alarms_before"), F.lit(0)) > 0).alias("has_alarm_before"),
        F.coalesce(F.sum("flips"), F.lit(0)).cast("long").alias("flip_count"),
        F.max("newest_key").alias("_newest"),
        F.max("flip_t").alias("latest_event_time"),
        F.coalesce(F.sum("imports"), F.lit(0)).cast("long").alias("import_count"),
        F.min("import_t").alias("first_import_time"),
    ).select(*keys, "last_on_before", "last_off_before", "has_alarm_before", "flip_count",
             F.when(flipped, 1 - F.pmod(F.col("_newest"), F.lit(2))).cast("int").alias("latest_state"),
             F.when(flipped, F.col("latest_event_time")).alias("latest_event_time"),
             "import_count", F.when(imported, F.col("first_import_time")).alias("first_import_time")))


def power_facts(windowed: DataFrame, alarms: DataFrame, imports: DataFrame,
                alarm_days: DataFrame | None = None, keys=WINDOW_KEYS, fractions: DataFrame | None = None) -> DataFrame:
    """``facts_of_slots`` of the slots of two logs. ``alarm_days`` defaults to summarising ``alarms``."""
    days = alarm_daily_summary(alarms) if alarm_days is None else alarm_days
    return facts_of_slots(windowed, signal_slots(alarms, imports, fractions), days, keys)


def facts_of_slots(windowed: DataFrame, slots: DataFrame, alarm_days: DataFrame, keys=WINDOW_KEYS, deal=None) -> DataFrame:
    """Everything the state rule reads, one row per windowed (batch, tier, meter) row, or per other ``keys``.

    The earlier-days rows (exactly one per windowed row) and the bound contributions are unioned and
    aggregated once, so every windowed row is present. ``alarm_days`` is an ``alarm_daily_summary``.
    """
    rows = _earlier_days(windowed, keys, alarm_days).unionByName(_bound_contributions(windowed, keys, slots, deal))
    return _aggregate(rows, keys)


def prior_facts(windowed: DataFrame, alarms: DataFrame, alarm_days: DataFrame | None = None) -> DataFrame:
    """Alarm facts before each distinct (meterid, win_start): alarms only.
    ``windowed`` needs the columns meterid and win_start only."""
    days = alarm_daily_summary(alarms) if alarm_days is None else alarm_days
    starts = windowed.select(*START_KEYS).distinct().withColumn("win_end", F.col("win_start"))
    rows = _earlier_days(starts, START_KEYS, days).unionByName(
        _bound_contributions(starts, START_KEYS, signal_slots(alarms, None)))
    return _aggregate(rows, START_KEYS)


def window_facts(windowed: DataFrame, alarms: DataFrame | None, imports: DataFrame | None) -> DataFrame:
    """In-window facts per distinct (meterid, win_start, win_end): flips and newest flip from the
    power alarms, imports from the import log; a log that is not given adds nothing."""
    needs = needs_of(windowed)
    slots = signal_slots(None if alarms is None else power_alarms(alarms), imports)
    return _aggregate(_bound_contributions(needs, NEED_KEYS, slots), NEED_KEYS)


def prior_of(facts: DataFrame) -> DataFrame:
    """``prior_facts`` columns of A12 and A13 from kept ``power_facts`` (tiers of one start share them)."""
    return facts.select(*START_KEYS, "last_on_before", "last_off_before", "has_alarm_before").distinct()


def flips_of(facts: DataFrame) -> DataFrame:
    """``window_facts`` columns of A15 and A17 from kept ``power_facts``."""
    return facts.select(*NEED_KEYS, "flip_count", "latest_state", "latest_event_time").distinct()


def imports_of(facts: DataFrame) -> DataFrame:
    """``window_facts`` columns of A18 from kept ``power_facts``."""
    return facts.select(*NEED_KEYS, "import_count", "first_import_time").distinct()


def power_status_before(prior: DataFrame) -> DataFrame:
    """Newest power-on and power-off alarm strictly before the window start,
    for meters with any alarm before it (``prior`` = ``prior_facts``)."""
    return prior.filter(F.col("has_alarm_before")).select(*START_KEYS, "last_on_before", "last_off_before")


def prior_power_code(prior: DataFrame) -> DataFrame:
    """0/1 code before the window, its time and the opposite status' time.
    ``prior_is_certain`` is false where the code is 0 only by default (no power-off seen)."""
    on, off = F.col("last_on_before"), F.col("last_off_before")
    return (power_status_before(prior)
            .select(*START_KEYS,
                    prior_code(on, off).alias("pre_status_code"),
                    prior_time(on, off).alias("pre_status_time"),
                    prior_opposite_time(on, off).alias("pre_opposite_status_time"),
                    off.isNotNull().alias("prior_is_certain")))


def flip_counts(inside: DataFrame) -> DataFrame:
    """Number of power alarms in the window, for windows with any (``inside`` = ``window_facts``)."""
    return inside.filter(F.col("flip_count") > 0).select(*NEED_KEYS, "flip_count")


def latest_flip(inside: DataFrame) -> DataFrame:
    """Newest power alarm in the window (state, time); a tie goes to power-off."""
    return inside.filter(F.col("flip_count") > 0).select(*NEED_KEYS, "latest_state", "latest_event_time")


def import_presence(inside: DataFrame) -> DataFrame:
    """A18: 'Yes'/'No' for import records in the window, and the first one's time."""
    return inside.select(*NEED_KEYS,
                         F.when(F.col("import_count") > 0, F.lit("Yes")).otherwise(F.lit("No")).alias("import_in_window"),
                         "first_import_time")


def state_of(facts: DataFrame, keys=WINDOW_KEYS) -> DataFrame:
    """The state text per windowed row."""
    code = F.when(F.col("has_alarm_before"), prior_code(F.col("last_on_before"), F.col("last_off_before")))
    return facts.select(*keys, power_state(F.col("flip_count") > 0, F.col("import_count") > 0, code)
                        .alias("meter_power_state"))


def meter_power_state(facts: DataFrame) -> DataFrame:
    """The state of every meter of every batch tier, in that tier's window."""
    return state_of(facts).select(*BATCH_KEYS, "sla_tier", "sla_order", "meterid", "meter_power_state")


def _ntz(value) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast(_TS)


def restrict_alarms(alarms: DataFrame, lo, hi) -> DataFrame:
    """Alarms with lo <= alarm_date <= hi (pushed to the scan as a range)."""
    return alarms.filter((F.col("alarm_date") >= _ntz(lo)) & (F.col("alarm_date") <= _ntz(hi)))


def restrict_imports(imports: DataFrame, lo, hi) -> DataFrame:
    return imports.filter((F.col("das_rtc") >= _ntz(lo)) & (F.col("das_rtc") <= _ntz(hi)))


def alarm_history(alarms: DataFrame, before) -> DataFrame:
    """Alarms strictly before ``before`` (the earlier-days pass needs no later day)."""
    return alarms.filter(F.col("alarm_date") < _ntz(before))

