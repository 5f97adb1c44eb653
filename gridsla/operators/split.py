"""Powered-off versus eligible meters per tier: A20-A23.

Long tables, one row per meter: a tier of millions of meters never becomes
one value. The split is reported beside the SLA figures and changes none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.power import is_powered_off
from .batches import BATCH_KEYS

POWERED_OFF_STATUS = "Powered Off"


def power_split(states: DataFrame) -> DataFrame:
    """Every meter of a tier with its state and whether it counts as powered off."""
    return states.withColumn("powered_off", is_powered_off(F.col("meter_power_state")))


def power_summary(split: DataFrame) -> DataFrame:
    """Per batch and tier: meters, powered-off meters, meters after removing those."""
    off = F.col("powered_off")
    return (split.groupBy(*BATCH_KEYS, "sla_tier")
            .agg(F.count(F.lit(1)).alias("total_meters"),
                 F.count_if(off).alias("power_off_meters"),
                 F.count_if(~off).alias("after_removing_power_off"))
            .orderBy(*BATCH_KEYS, "sla_tier"))


def powered_off_list(split: DataFrame) -> DataFrame:
    """(tier, meter, 'Powered Off') rows, the content of the powered-off CSV."""
    return (split.filter(F.col("powered_off"))
            .select(*BATCH_KEYS, "sla_tier", "meterid", F.lit(POWERED_OFF_STATUS).alias("status")))


def eligible_list(split: DataFrame) -> DataFrame:
    """Meters of each tier that are not powered off."""
    return split.filter(~F.col("powered_off")).select(*BATCH_KEYS, "sla_tier", "meterid")
