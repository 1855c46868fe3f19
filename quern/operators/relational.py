"""Joins that need more than an equi-join: ranges by bucket, as-of by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, bucket: float) -> DataFrame:
    """Points (value) within spans [low, high]: spans are spelt out by bucket, the join is on the bucket.

    A span costs one row a bucket that it meets, so the bucket should be about as wide as the spans.
    """
    at = F.floor(F.col("value") / bucket)
    each = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))
    return points.withColumn("_b", at).join(each, "_b").where("value BETWEEN low AND high").drop("_b")


def as_of_join(left: DataFrame, right: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row's time: one shuffle, no pairs."""
    both = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(by, ts, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    w = Window.partitionBy(by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"last_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")
