"""Ordered groups looked at in ranges, so that a group with most of the rows is spread over many tasks.

Ranges lie between quantiles of the order over all rows, so that they hold about as many rows each; what a window over a whole
group would hand from row to row is worked out inside each range, and handed on between ranges by a row for each group and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 64


def in_ranges(rows: DataFrame, at: Column, parts: int = PARTS, name: str = "__range") -> DataFrame:
    """``rows`` with the number of their range of ``at``; rows with one value of it are in one range, a null is in the first."""
    cuts = rows.agg(F.percentile_approx(at, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10_000))).first()[0]
    above = [F.when(at > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts or []))]
    return rows.withColumn(name, reduce(Column.__add__, above, F.lit(0)))
