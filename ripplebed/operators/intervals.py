"""Joins by overlap of intervals, as equal joins over bins.

Both sides are copied into the bins of fixed width that their intervals touch, joined by
group and bin, and then compared exactly; a pair counts in the first bin that both
touch, so it comes once.  Nothing is collected, and a group that holds most rows is
spread over tasks by its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_bins(df: DataFrame, start: Column, end: Column, width: float, prefix: str) -> DataFrame:
    """A row for each bin that [start, end) touches: ``{prefix}bin`` and, as ``{prefix}first``, the first of them; empty intervals touch none."""
    first = F.floor(start / width).cast("long")
    last = F.greatest(F.ceil(end / width).cast("long") - 1, first)
    bins = F.when(end > start, F.sequence(first, last))
    return df.withColumn(f"{prefix}first", first).withColumn(f"{prefix}bin", F.explode(bins))


def overlaps(left: DataFrame, right: DataFrame, by: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: float) -> DataFrame:
    """All pairs of rows alike in ``by`` whose half-open intervals overlap.

    The sides' columns must have different names, but for ``by``.  ``width`` should be
    about the usual length of an interval: each is copied into length / width + 1 bins.
    Rows with nulls in bounds or groups find no partner.
    """
    (a, b), (c, d) = left_bounds, right_bounds
    one = in_bins(left, F.col(a), F.col(b), width, "_l")
    two = in_bins(right, F.col(c), F.col(d), width, "_r")
    pairs = one.join(two.withColumnRenamed("_rbin", "_lbin"), [*by, "_lbin"])
    met = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("_lbin") == F.greatest("_lfirst", "_rfirst"))
    return pairs.where(met).drop("_lbin", "_lfirst", "_rfirst")


def within(points: DataFrame, intervals: DataFrame, by: list[str], at: str, bounds: tuple[str, str], width: float) -> DataFrame:
    """All pairs of a point and an interval [start, end) that holds it."""
    start, end = bounds
    spread = in_bins(intervals, F.col(start), F.col(end), width, "_r").drop("_rfirst")
    found = points.withColumn("_rbin", F.floor(F.col(at) / width).cast("long")).join(spread, [*by, "_rbin"])
    return found.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_rbin")
