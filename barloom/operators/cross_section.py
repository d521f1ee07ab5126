"""Per-date (cross-sectional) operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import finite

TIME = "timestamp"


def z_score(x: str, by: list[str] | None = None) -> Column:
    """Sample deviation; null for a constant or single-member date."""
    day = Window.partitionBy(*(by or [TIME]))
    spread = F.when(F.count(x).over(day) > 1, F.stddev_samp(x).over(day))
    flat = F.max(x).over(day) == F.min(x).over(day)
    return F.when(~flat, F.try_divide(F.col(x) - F.avg(x).over(day), spread))


def rank_pct(x: str, by: list[str] | None = None, valid: Column | None = None) -> Column:
    """Average rank over the number of values; nulls stay null."""
    by = by or [TIME]
    there = F.col(x).isNotNull() if valid is None else F.col(x).isNotNull() & valid
    ranked = Window.partitionBy(*by, there).orderBy(x)
    ties, every = Window.partitionBy(*by, there, x), Window.partitionBy(*by, there)
    return F.when(there, (F.rank().over(ranked) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(F.lit(1)).over(every))


def normalize(df: DataFrame, features: list[str], mode: str = "none") -> DataFrame:
    """Replace features by their value, z-score or rank inside each date."""
    if mode == "none":
        return df
    if mode not in ("zscore", "rank"):
        raise ValueError(f"Unknown feature normalization: {mode}. Available: none, zscore, rank")
    change = z_score if mode == "zscore" else rank_pct
    return df.select(*(change(c).alias(c) if c in features else F.col(c) for c in df.columns))


def buckets(df: DataFrame, x: str = "log_total_mkt_cap", k: int = 5, name: str = "market_cap_bucket") -> DataFrame:
    """Quantile label per date by position: ceil(row / count * k); ties by symbol, nulls unlabelled."""
    there = F.col(x).isNotNull()
    order = Window.partitionBy(TIME, there).orderBy(x, "symbol")
    place = F.row_number().over(order) / F.count(F.lit(1)).over(Window.partitionBy(TIME, there))
    q = F.least(F.greatest(F.ceil(place * k), F.lit(1)), F.lit(k)).cast("int")
    label = F.when(q == 1, F.lit("cap_q1_smallest")).when(q == k, F.lit(f"cap_q{k}_largest")).otherwise(F.concat(F.lit("cap_q"), q.cast("string")))
    return df.withColumn(name, F.when(there, label))


def score_ranks(df: DataFrame, x: str = "prediction") -> DataFrame:
    """score_rank (highest first, ties share the best) and score_percentile of each date."""
    there = F.col(x).isNotNull()
    order = Window.partitionBy(TIME, there).orderBy(F.desc(x))
    return df.withColumn("score_rank", F.when(there, F.rank().over(order))).withColumn("score_percentile", rank_pct(x))


def future_return(horizon: int, close: str = "close") -> Column:
    if horizon < 1:
        raise ValueError("label horizon must be at least 1")
    ahead = F.lead(close, horizon).over(Window.partitionBy("symbol").orderBy(TIME))
    return finite(F.try_divide(ahead, F.col(close)) - 1)


def with_label(df: DataFrame, horizon: int = 5, ranked: bool = False) -> DataFrame:
    """future_return_{h}d and, if ``ranked``, future_return_rank_{h}d."""
    name = f"future_return_{horizon}d"
    out = df.withColumn(name, future_return(horizon))
    return out.withColumn(f"future_return_rank_{horizon}d", rank_pct(name)) if ranked else out
