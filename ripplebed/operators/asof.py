"""As-of joins over range partitions.

Both sides are sorted together by group and place.  Within a range partition the last
row of the right side goes along by a window; what a partition begins with is the last
one of the partitions before it, of which there are as many as partitions.  So no side
is broadcast, nothing is paired by range conditions, and neither a hot group nor a hot
place has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplebed.operators.tables import staged


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str) -> DataFrame:
    """Each row of ``left``, and of the rows of ``right`` alike in ``by`` the last whose place isn't beyond its own; nulls where there is none.

    Sides must have different column names but for ``by``.  Of right rows at one place
    the greatest counts, compared column by column; rows of ``right`` with a null place
    don't count, and rows of ``left`` with one find none.  Null groups are a group.
    """
    theirs = [c for c in right.columns if c not in by]
    one = right.where(F.col(right_at).isNotNull()).select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*theirs).alias("_right"))
    two = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    order = [*(F.col(c).asc_nulls_first() for c in by), F.col("_at").asc_nulls_first(), F.col("_side")]
    # Many rows at one place are parted by what they hold, the right ones in their order.
    both = one.unionByName(two, allowMissingColumns=True).withColumn("_tie", F.when(F.col("_side") == 1, F.xxhash64("_left")))
    ties = [F.col("_right"), F.col("_tie")]
    dealt = staged(both.repartitionByRange(*order, *ties).withColumn("_part", F.spark_partition_id()), "asof")
    inside = F.last("_right", ignorenulls=True).over(Window.partitionBy("_part", *by).orderBy(F.col("_at").asc_nulls_first(), "_side", *ties))
    last = dealt.where("_side = 0").groupBy("_part").agg(F.max(F.struct(F.struct(*(F.struct(F.col(c).isNotNull().alias("some"), F.col(c).alias("value")).alias(c) for c in by), F.lit(0).alias("_")).alias("g"), "_at", "_right")).alias("_last"))
    parts = dealt.select("_part").distinct().join(last, "_part", "left")
    # One row for each partition.
    earlier = F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", earlier.alias("_before"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_before.g.`{c}`.value"))
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_inside", F.when(F.col("_before").isNotNull() & same, F.col("_before._right"))))
    rows = dealt.withColumn("_inside", inside).where("_side = 1").join(F.broadcast(parts), "_part").withColumn("_found", found)
    return rows.select("_left.*", *(F.col(f"_found.`{c}`").alias(c) for c in theirs))
