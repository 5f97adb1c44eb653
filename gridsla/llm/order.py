"""Gapless positions in a global order, and joins to tables with a few very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import MAX_BROADCAST_ROWS, materialize

HEAVY_KEYS = 10_000


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with the long column ``name``: 0, 1, 2, ... in the order given, as a written table.

    The table is range partitioned and sorted within its partitions; a row's position is its place there
    plus the rows of the partitions before, of which there is one count each. ``order`` should end in a
    column that tells all rows apart: equal rows share a partition. ``df`` is read twice, so pass a written
    table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                        .withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(dealt.groupBy(part.alias("part")).count().collect())  # one row a partition
    starts, seen = [], 0
    for p, n in sizes:
        starts.append((p, seen))
        seen += n
    table = spark.createDataFrame(starts, "_part long, _start long")
    out = dealt.join(F.broadcast(table), part == F.col("_part")).select(
        *df.columns, (F.col("_start") + place).alias(name))
    out._gridsla_path = dealt._gridsla_path
    return out


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, heavy: int = HEAVY_KEYS) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row per ``key``) that no large group slows down.

    ``size`` is the column of ``groups`` with the rows that a key has. Keys with more than one in ``heavy`` of
    them all number less than ``heavy``; their part of ``groups`` is broadcast and their rows stay where
    they are. The other rows are shuffled. Both sides should be written tables; no key is null.
    """
    if groups.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key)
    total = groups.agg(F.sum(size)).first()[0]
    large = F.broadcast(groups.where(F.col(size) * heavy > total))
    small = groups.where(F.col(size) * heavy <= total)
    near = rows.join(large, key)
    far = rows.join(large.select(key), key, "left_anti").join(small, key)
    return near.unionByName(far)
