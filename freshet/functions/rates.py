"""Durations, rates and flow weights, in whole numbers; a zero or missing divisor gives 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """Integer division, 0 where the divisor is 0 or NULL."""
    return F.when(b != 0, F.call_function("div", a.cast("long"), b.cast("long"))).otherwise(F.lit(0).cast("long"))


def weight(cnt_flows: Column) -> Column:
    """Flows that a record stands for: missing or 0 is 1."""
    n = F.coalesce(cnt_flows, F.lit(0).cast("long"))
    return F.when(n == 0, F.lit(1).cast("long")).otherwise(n)
