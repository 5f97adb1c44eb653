"""The meters of each tier as sets of bits: sizes, overlaps and members without a distinct shuffle.

Meters are numbered by a dictionary table (meterid, meter_no), gapless in the order of their ids. A tier's set is a table of
blocks of 64 meters, one long of bits each; a bit set twice is set once, so the jobs themselves are aggregated
(map-side, by a plain bit-or) instead of being made distinct first, and sets are united, intersected and counted
block by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import tier_label
from ..plans.materialize import broadcast_if_small
from ..plans.ordering import numbered
from ..sources.policy import DEFAULT_POLICY, TaskPolicy
from .batches import BATCH_KEYS
from .sla import _max_tiers

BLOCK_BITS = 6


def _bit(place):
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def meter_dictionary(jobs: DataFrame) -> DataFrame:
    """(meterid, meter_no) of every meter of the jobs; a null meter has no number."""
    return numbered(jobs.select("meterid").filter(F.col("meterid").isNotNull()).distinct(), F.asc("meterid"), name="meter_no")


def tier_sets(timed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(batch keys, sla_order, block, members): bit i of a block is meter 64 * block + i."""
    place = F.col("meter_no").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    return (timed.join(broadcast_if_small(dictionary), "meterid")
            .select(*BATCH_KEYS, "sla_order", F.shiftright("meter_no", BLOCK_BITS).alias("block"), _bit(place).alias("bit"))
            .groupBy(*BATCH_KEYS, "sla_order", "block").agg(F.bit_or("bit").alias("members")))


def tier_overlaps(sets: DataFrame, policy: tuple[TaskPolicy, ...] = DEFAULT_POLICY) -> DataFrame:
    """Per batch and two of its tiers (of those with meters): their sizes and the meters they have in common.

    One aggregate puts a block's sets of all tiers side by side; no set is joined to another.
    """
    k = _max_tiers(policy)
    side = sets.groupBy(*BATCH_KEYS, "block").agg(
        *[F.bit_or(F.when(F.col("sla_order") == i, F.col("members"))).alias(f"m{i}") for i in range(1, k + 1)])
    pairs = [(a, b) for a in range(1, k + 1) for b in range(a + 1, k + 1)]

    def total(column, name):
        return F.coalesce(F.sum(F.bit_count(column)), F.lit(0)).cast("long").alias(name)
    sums = side.groupBy(*BATCH_KEYS).agg(
        *[total(F.col(f"m{i}"), f"n{i}") for i in range(1, k + 1)],
        *[total(F.col(f"m{a}").bitwiseAND(F.col(f"m{b}")), f"c{a}_{b}") for a, b in pairs])
    rows = sums.select(*BATCH_KEYS, F.explode(F.array(*[F.struct(
        F.lit(a).alias("order_a"), F.lit(b).alias("order_b"), F.col(f"n{a}").alias("meters_a"), F.col(f"n{b}").alias("meters_b"),
        F.col(f"c{a}_{b}").alias("common_meters")) for a, b in pairs])).alias("x")).select(*BATCH_KEYS, "x.*")
    return rows.filter((F.col("meters_a") > 0) & (F.col("meters_b") > 0)).select(
        *BATCH_KEYS, tier_label("task", "order_a", policy).alias("tier_a"), tier_label("task", "order_b", policy).alias("tier_b"),
        "meters_a", "meters_b", "common_meters")


def set_members(sets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The sets as rows again: (batch keys, sla_order, meterid)."""
    places = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda i: F.getbit("members", i) == 1)
    numbers = sets.select(*BATCH_KEYS, "sla_order", "block", F.explode(places).alias("place")).select(
        *BATCH_KEYS, "sla_order", (F.col("block") * F.lit(1 << BLOCK_BITS) + F.col("place")).alias("meter_no"))
    return numbers.join(broadcast_if_small(dictionary), "meter_no").select(*BATCH_KEYS, "sla_order", "meterid")
