"""Joins whose left side may hold hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import is_broadcast_sized, materialise

#: A key is hot from this part of all rows on, so there are no more hot keys than this.
PARTS = 2000
#: Parts into which the rows of a hot key are dealt where the other side's rows of it are too many to broadcast.
SALT = 64


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on one key; both are read more than once, so they should be written tables.

    A right side that is small in rows and bytes is broadcast. Otherwise the rows of the left's hot keys, PARTS keys at most,
    meet the right's rows of those keys by broadcast if these are small in rows and bytes, and else by key and salt: each of
    SALT parts of the left's rows with a copy of the right's. Other keys are shuffled. Null keys meet nothing.
    """
    if is_broadcast_sized(right):
        return left.join(F.broadcast(right), key, how)
    n = left.count()
    counted = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    # PARTS keys at most, whatever the input
    hot = materialise(counted.where(F.col("_n") > max(1, n // PARTS)).select(key, F.lit(True).alias("_hot")), "hot-keys")
    if not hot.limit(1).count():
        return left.join(right, key, how)
    columns = [c for c in left.columns if c != key]
    marked = left.join(F.broadcast(hot), key, "left")
    many, others = marked.where("_hot").select(key, *columns), marked.where("_hot IS NULL").select(key, *columns)
    held = materialise(right.join(F.broadcast(hot.select(key)), key, "left_semi"), "hot-rows")
    if is_broadcast_sized(held):
        spread = many.join(F.broadcast(held), key, how)
    else:
        parts = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        dealt = many.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
        spread = dealt.join(parts, [key, "_salt"], how).drop("_salt")
    return spread.unionByName(others.join(right, key, how))
