"""Backward as-of join by union and one window: no range join, one exchange on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: str = "symbol", tie: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Each ``left`` row with the latest ``right`` row of its key at or before its time.

    All columns of ``right`` but the key are added under ``prefix``; they are null without
    a match.  Of equal times the row that sorts last by ``tie`` wins.  The payload moves as
    one struct, so a null attribute of the latest row is not replaced by an older value.
    """
    payload = [c for c in right.columns if c != by]
    clash = {prefix + c for c in payload} & set(left.columns)
    if clash:
        raise ValueError(f"as-of join would repeat columns: {', '.join(sorted(clash))}")
    own = left.select(F.col(by).alias("_key"), F.col(left_time).cast("timestamp_ntz").alias("_time"), F.lit(1).alias("_side"), F.struct("*").alias("_left"))
    other = right.select(F.col(by).alias("_key"), F.col(right_time).cast("timestamp_ntz").alias("_time"), F.lit(0).alias("_side"), F.struct(*payload).alias("_right"))
    other = other.where("_key is not null and _time is not null")
    both = own.unionByName(other, allowMissingColumns=True)
    order = ["_time", "_side", *(F.col("_right")[c] for c in (tie or []))]
    seen = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_match", F.last(F.when(F.col("_side") == 0, F.col("_right")), ignorenulls=True).over(seen)).where("_side = 1")
    return both.select("_left.*", *(F.col("_match")[c].alias(prefix + c) for c in payload))
