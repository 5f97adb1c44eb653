"""Exact report arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int_div(a: Column, b: Column) -> Column:
    """Integral division of non-negative longs (SQL ``div``) without a double rounding step."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def percentage(part: Column, total: Column) -> Column:
    """round(part / total * 100, 2), half up, exact; NULL when total is 0.

    Computed on integers as ((part * 20000 + total) div (2 * total)) / 100, so no
    decimal intermediate is rounded twice.
    """
    part = part.cast("long")
    total = total.cast("long")
    scaled = part * F.lit(20000) + total
    return F.when(total != 0, _int_div(scaled, total * F.lit(2)) / F.lit(100.0))


def target_count(total: Column, target: Column) -> Column:
    """ceil(total * target) as bigint; target is DECIMAL so the product is exact."""
    return F.ceil(total.cast("decimal(20,0)") * target).cast("long")


def gap(needed: Column, done: Column) -> Column:
    """greatest(needed - done, 0) as bigint."""
    return F.greatest((needed - done).cast("long"), F.lit(0).cast("long"))
