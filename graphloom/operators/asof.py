"""The latest earlier value by key, with long histories split over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_before(rows: DataFrame, key: str, order: str, value: str, out: str, buckets: int = 64) -> DataFrame:
    """rows with `out`: the last non-null `value` of the same key before the row's `order`.

    The order is cut into ranges of about equal rows; the search runs within (key, range), and the last value of
    earlier ranges is carried in, so a key with a large share of the rows is no single task.
    """
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / buckets for i in range(1, buckets)], 1000)).first()[0]
    above = [F.when(F.col(order).cast("double") > F.lit(float(c)), 1).otherwise(0) for c in sorted(set(cuts or []))]
    dealt = rows.withColumn("_b_", reduce(lambda a, b: a + b, above, F.lit(0)))
    inside = Window.partitionBy(key, "_b_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("_near_", F.last(value, ignorenulls=True).over(inside))
    ends = dealt.groupBy(key, "_b_").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end_"))
    earlier = Window.partitionBy(key).orderBy("_b_").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.withColumn("_far_", F.last("_end_", ignorenulls=True).over(earlier)).drop("_end_")
    return near.join(far, [key, "_b_"]).withColumn(out, F.coalesce("_near_", "_far_")).drop("_b_", "_near_", "_far_")
