"""Exports written by the executors: CSV, and large tables in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Header CSV in ``path``; one file per task, so the write is parallel."""
    writer = df.write.mode(mode).option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_sorted(df: DataFrame, path: str, order: tuple[str, ...], fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A table whose files, read by name, are in the order of the columns ``order``.

    Rows are range partitioned by a sample of the order and sorted within their partition, so every task sorts and
    writes a share and none sorts the whole. The rows are written as they come first and sorted from there: the
    sampling would otherwise compute ``df`` twice.
    """
    from ..plans.materialize import discard, materialize
    rows = materialize(df)
    try:
        rows.orderBy(*order).write.mode(mode).format(fmt).save(path)
    finally:
        discard(rows)
