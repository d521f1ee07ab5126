"""Scores of single symbols with their same-day context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.cross_section import score_ranks


def padding(estimate: int) -> int:
    """History rows to load for one symbol."""
    return max(estimate + 20, 2 * estimate, 40)


def latest_row(features: DataFrame, columns: list[str], day: str, symbol: str) -> DataFrame:
    """The symbol's last complete row on or before ``day`` (none: empty)."""
    rows = features.where((F.col("symbol") == symbol) & (F.to_date("timestamp") <= F.lit(day).cast("date"))).dropna(subset=columns)
    return rows.orderBy(F.desc("timestamp")).limit(1)


def context(scored: DataFrame, day: str, symbol: str, universe: list[str] | None = None) -> DataFrame:
    """The symbol's score, rank and percentile on its day, with the universe's best, median and worst.

    A symbol outside ``universe`` joins it for the day.
    """
    rows = scored.where(F.to_date("timestamp") == F.lit(day).cast("date")).where("prediction is not null")
    if universe is not None:
        rows = rows.where(F.col("symbol").isin([*universe, symbol]))
    whole = Window.partitionBy("timestamp")
    with_context = score_ranks(rows).select(
        "symbol", "timestamp", "prediction", "score_rank", "score_percentile",
        F.count("*").over(whole).alias("context_size"), F.max("prediction").over(whole).alias("top_score"), F.percentile("prediction", 0.5).over(whole).alias("median_score"), F.min("prediction").over(whole).alias("bottom_score"),
    )
    return with_context.where(F.col("symbol") == symbol)
