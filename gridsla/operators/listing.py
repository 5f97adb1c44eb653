"""A window's flips as ordered text, in chunks: A16 as the user reads it.

The whole history of a meter as one ordered string would gather it in one value and one task. Here a window's
power-on and power-off entries, newest first, are cut into rows of ``size`` entries with gapless numbers; the texts of a
window's chunks joined in order are the one string.

An entry's number in its window is the difference of two counts: the meter's flips of that state up to the window's end,
and up to the entry. Both come from counts per second that are summed up per (meter, day), and per meter over days, so
no window is sorted as a whole and a busy meter-day is at most 172,800 rows of one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.power import flip_state, flip_text
from ..functions.timecols import day_of
from .power import NEED_KEYS, _micros, _signals, _window_days, power_alarms, slot_of

DEFAULT_CHUNK = 1_000
SEPARATOR = ", "


def _running(rows: DataFrame, keys: list[str], order: list[str], name: str, inclusive: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def flip_numbers(alarms: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers 1, 2, ... of each meter's flips of one state, oldest first, and the number reached at given ends.

    ``ends``: distinct (meterid, win_end). Returns (meterid, state, day, t, number) and (meterid, state, win_end, reached).
    Flips of one time and state are in any order: their entries are equal.
    """
    flips = (_signals(power_alarms(alarms), None).filter(F.col("meterid").isNotNull())
             .select("meterid", flip_state(F.col("is_on")).alias("state"), "day", "t", slot_of(F.col("t")).alias("slot")))
    key, none = ["meterid", "state", "day"], F.lit(None)
    slots = flips.groupBy(*key, "slot").agg(F.count(F.lit(1)).alias("n")).select(
        *key, "slot", F.lit(0).alias("side"), "n", F.col("slot").alias("p"), none.cast("timestamp_ntz").alias("win_end"))
    marks = ends.select("meterid", F.explode(F.array(F.lit(0), F.lit(1))).alias("state"), day_of(F.col("win_end")).alias("day"),
                        none.cast("long").alias("slot"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("n"),
                        _micros(F.col("win_end")).alias("p"), "win_end")
    both = slots.unionByName(marks)
    in_day = _running(both, key, ["p", "side"], "upto", inclusive=True)
    days = _running(both.groupBy(*key).agg(F.sum("n").alias("n")), ["meterid", "state"], ["day"], "before", inclusive=False)
    placed = in_day.join(days.select(*key, "before"), key).withColumn("total", F.col("before") + F.col("upto"))
    within = Window.partitionBy(*key, "slot").orderBy("t")
    starts = placed.filter("side = 0").select(*key, "slot", (F.col("total") - F.col("n")).alias("start"))
    numbers = (flips.withColumn("rn", F.row_number().over(within)).join(starts, [*key, "slot"])
               .select(*key, "t", (F.col("start") + F.col("rn")).alias("number")))
    return numbers, placed.filter("side = 1").select("meterid", "state", "win_end", F.col("total").alias("reached"))


def flip_listing_chunks(needs: DataFrame, alarms: DataFrame, size: int = DEFAULT_CHUNK) -> DataFrame:
    """The entries of each window and state, newest first, joined in rows of ``size`` (the last one: fewer).

    Window bounds are whole seconds. A window without flips of a state has no row for it; a null meter has none.
    Columns: the window, state (1 = power on), chunk (from 0), entries, flip_times.
    """
    if size < 1:
        raise ValueError("size must be positive")
    numbers, reached = flip_numbers(alarms, needs.select("meterid", "win_end").distinct())
    ends = needs.join(reached, ["meterid", "win_end"]).select(*NEED_KEYS, "state", "reached")
    spans = _window_days(ends, (*NEED_KEYS, "state", "reached"))
    t = F.col("t")
    entries = (numbers.join(spans, ["meterid", "state", "day"])
               .filter((t >= F.col("win_start")) & (t <= F.col("win_end")))
               .select(*NEED_KEYS, "state", (F.col("reached") - F.col("number")).alias("rank"),
                       flip_text(F.col("state"), t).alias("entry")))
    chunk = F.expr(f"rank div {int(size)}").cast("long")
    gathered = entries.groupBy(*NEED_KEYS, "state", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "entry"))).alias("list"))
    return gathered.select(*NEED_KEYS, "state", "chunk", F.size("list").cast("long").alias("entries"),
                           F.array_join(F.col("list.entry"), SEPARATOR).alias("flip_times"))
