"""Signal quality over scored panels: one pass for any set of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.cross_section import TIME
from barloom.schema import finite

METRICS = ("ic", "ic_std", "icir", "rank_ic", "rank_ic_std", "rank_icir", "ndcg_at_10", "mae", "r2")


def _corr(x: str, y: str) -> Column:
    flat = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when((F.count(F.when(F.col(y).isNotNull(), F.col(x))) > 1) & ~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def daily(scored: DataFrame, prediction: str = "prediction", label: str = "label", by: list[str] | None = None, k: int = 10) -> DataFrame:
    """ic, rank_ic and ndcg_at_10 of each date (and slice ``by``).

    Rows without a prediction or label take no part.  Dates with fewer than two rows or a
    constant side have no ic; dates whose ideal gain is not positive, or overflows, no ndcg.  Ties are
    ranked by symbol.
    """
    by = [*(by or []), TIME]
    rows = scored.select(*by, "symbol", F.col(prediction).alias("p"), F.col(label).alias("y")).where("p is not null and y is not null")
    # One sort for each side: from the row numbers come the ranks (their mean over ties) and, counted from the end, the places.
    rows = rows.withColumn("m", F.count("*").over(Window.partitionBy(*by)))
    for c in ("p", "y"):
        rows = rows.withColumn(f"n{c}", F.row_number().over(Window.partitionBy(*by).orderBy(c, F.desc("symbol"))))
        rows = rows.withColumn(f"r{c}", F.avg(f"n{c}").over(Window.partitionBy(*by, c)) / F.col("m")).withColumn(f"n{c}", F.col("m") + 1 - F.col(f"n{c}"))
    gain = F.pow(F.lit(2.0), F.col("y")) - 1
    part = lambda n: F.sum(F.when(F.col(n) <= k, gain / F.log2(F.col(n) + 1)))
    out = rows.groupBy(*by).agg(_corr("p", "y").alias("ic"), _corr("rp", "ry").alias("rank_ic"), part("np").alias("dcg"), part("ny").alias("idcg"), F.sum(F.abs(F.col("p") - F.col("y"))).alias("abs_error"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq_error"), F.count("*").alias("n"), F.sum("y").alias("sum_y"), F.sum(F.col("y") * F.col("y")).alias("sum_y2"))
    return out.withColumn("ndcg_at_10", F.when(F.col("idcg") > 0, finite(F.col("dcg") / F.col("idcg")))).drop("dcg", "idcg")


def summary(days: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The nine metrics of each slice, from ``daily``; a frame without dates gives zeros.

    Deviations over dates are population ones and 0 for a single date; a ratio with
    deviation 0 is 0.
    """
    spread = lambda c: F.when(F.count(c) > 1, F.stddev_pop(c)).otherwise(F.lit(0.0))
    n, sse = F.sum("n"), F.sum("sq_error")
    sst = F.sum("sum_y2") - F.pow(F.sum("sum_y"), 2) / n
    r2 = F.when(sst > 0, 1 - F.try_divide(sse, sst)).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    aggregates = [F.avg("ic").alias("ic"), spread("ic").alias("ic_std"), F.avg("rank_ic").alias("rank_ic"), spread("rank_ic").alias("rank_ic_std"), F.avg("ndcg_at_10").alias("ndcg_at_10"), F.try_divide(F.sum("abs_error"), n).alias("mae"), r2.alias("r2")]
    out = days.groupBy(*by).agg(*aggregates) if by else days.agg(*aggregates)
    steady = lambda m, s: F.when(F.col(s) > 0, F.try_divide(F.col(m), F.col(s))).otherwise(F.lit(0.0))
    out = out.withColumn("icir", steady("ic", "ic_std")).withColumn("rank_icir", steady("rank_ic", "rank_ic_std"))
    return out.select(*(by or []), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in METRICS))


def evaluate(scored: DataFrame, prediction: str = "prediction", label: str = "label", by: list[str] | None = None) -> DataFrame:
    return summary(daily(scored, prediction, label, by), by)


def mean_of_folds(folds: DataFrame) -> DataFrame:
    """Unweighted mean of each metric over folds."""
    return folds.agg(*(F.avg(c).alias(c) for c in METRICS))
