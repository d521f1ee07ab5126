"""Decay, slices and overfitting diagnostics of scored panels."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import column
from barloom.functions.windows import pct_change, std
from barloom.operators import metrics
from barloom.operators.cross_section import buckets, future_return
from barloom.operators.references import is_small
from barloom.plans.compiler import evaluate


def ic_decay(scored: DataFrame, horizons: list[int], prediction: str = "prediction") -> DataFrame:
    """horizon, rows (with a return) and the metrics against the return that many surviving rows ahead.

    Horizons are taken once each, those below 1 left out.  All leads come from one
    window; the horizons are stacked and evaluated in one pass.
    """
    wanted = sorted({h for h in horizons if h >= 1})
    ahead = scored.select("symbol", "timestamp", prediction, *(future_return(h).alias(f"_h{h}") for h in wanted))
    pairs = ahead.select("symbol", "timestamp", prediction, F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("label")) for h in wanted))).alias("x")).select("symbol", "timestamp", prediction, "x.*")
    days = metrics.daily(pairs, prediction, "label", ["horizon"])
    found = metrics.summary(days, ["horizon"]).join(days.groupBy("horizon").agg(F.sum("n").alias("rows")), "horizon")
    every = scored.sparkSession.createDataFrame([(h,) for h in wanted], "horizon int")
    return every.join(F.broadcast(found), "horizon", "left").select("horizon", F.coalesce("rows", F.lit(0)).alias("rows"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in metrics.METRICS))


def with_year(df: DataFrame) -> DataFrame:
    """year_window: oos_ and the calendar year, with _ytd for a last year that doesn't reach 12-31."""
    year = F.concat(F.lit("oos_"), F.year("timestamp").cast("string"))
    # A row per year, from partial maxima: a few dozen.
    last = df.groupBy(F.year("timestamp").alias("_year")).agg((F.date_format(F.max("timestamp"), "MM-dd") == "12-31").alias("_whole"))
    joined = df.join(F.broadcast(last), F.year("timestamp").eqNullSafe(F.col("_year")), "left")
    return joined.withColumn("year_window", F.when(F.col("_whole"), year).otherwise(F.concat(year, F.lit("_ytd")))).drop("_year", "_whole")


def regimes(index: DataFrame, window: int = 20) -> DataFrame:
    """timestamp, trend, vol: the index's return and volatility over ``window`` bars (one small series)."""
    time = "timestamp" if "timestamp" in index.columns else "date"
    series = index.select(F.lit("index").alias("symbol"), F.col(time).cast("timestamp_ntz").alias("timestamp"), F.col("close").cast("double").alias("close"))
    return evaluate(series, {"trend": pct_change(column("close"), window), "vol": std(pct_change(column("close")), window)}, ["timestamp"])


def with_regime(df: DataFrame, index: DataFrame, window: int = 20) -> DataFrame:
    """market_regime: trend_{up,down}_{high,low}_vol against medians over the panel's rows; null without history."""
    series = regimes(index, window)
    joined = df.join(F.broadcast(series) if is_small(index) else series, "timestamp", "left")
    # Both columns hold one value per date, so the exact medians are cheap; two numbers reach the driver.
    cut = joined.agg(F.percentile("trend", 0.5).alias("trend"), F.percentile("vol", 0.5).alias("vol")).first()
    up = F.when(F.col("trend") >= F.lit(cut["trend"]), "up").otherwise("down")
    high = F.when(F.col("vol") >= F.lit(cut["vol"]), "high").otherwise("low")
    known = F.col("trend").isNotNull() & F.col("vol").isNotNull()
    return joined.withColumn("market_regime", F.when(known, F.concat(F.lit("trend_"), up, F.lit("_"), high, F.lit("_vol")))).drop("trend", "vol")


def slices(df: DataFrame, keys: list[str], prediction: str = "prediction", label: str = "label") -> DataFrame:
    """slice, bucket, rows and the metrics for every value of every key column, in one pass; ``in_order`` sorts them."""
    stacked = df.select("symbol", "timestamp", prediction, label, F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.col(k).cast("string").alias("bucket")) for k in keys))).alias("x")).select("symbol", "timestamp", prediction, label, "x.*").where("bucket is not null")
    counted = stacked.groupBy("slice", "bucket").agg(F.count("*").alias("rows"))
    return counted.join(metrics.evaluate(stacked, prediction, label, ["slice", "bucket"]), ["slice", "bucket"])


def in_order(found: DataFrame) -> DataFrame:
    """Slices by name, their buckets by rows, most first, then by name."""
    return found.orderBy("slice", F.desc("rows"), "bucket")


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value, by column."""
    return df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))


def with_caps(df: DataFrame, panel: DataFrame, name: str = "log_total_mkt_cap") -> DataFrame:
    """``df`` with the panel's market cap of the same symbol and timestamp; null where it has none."""
    caps = panel.select("symbol", "timestamp", name).dropDuplicates(["symbol", "timestamp"])
    return df.drop(name).join(caps, ["symbol", "timestamp"], "left")


def with_cap_buckets(df: DataFrame, k: int = 5) -> DataFrame:
    return buckets(df, "log_total_mkt_cap", k)


def overfit_probability(trials: list[list[float]], maximize: bool = True, orientation: str = "replicate") -> dict[str, float | int | None]:
    """Probability of backtest overfitting over all halves of the folds.

    ``trials`` holds each trial's fold scores.  In every split the best trial of one half
    is ranked in the other; ties go to the earlier trial.  ``replicate`` keeps the
    published pipeline's orientation (rank 1 is best, so a good trial lands near 0 and
    counts as overfit); ``paper`` counts ranks from the worst.
    """
    if orientation not in ("replicate", "paper"):
        raise ValueError("orientation is replicate or paper")
    usable = [t for t in trials if t]
    even = len({len(t) for t in usable}) == 1
    n_trials, n_folds = len(usable), len(usable[0]) if even else 0
    out = {"pbo": None, "combination_count": 0, "trial_count": n_trials if even else len(trials), "fold_count": n_folds, "selected_lambda": None, "selected_oos_rank_pct": None}
    if n_trials < 2 or n_folds < 2:
        return out
    shares = []
    for inside in combinations(range(n_folds), n_folds // 2):
        outside = set(range(n_folds)).difference(inside)
        order = lambda on: sorted(range(n_trials), key=lambda t: (-1 if maximize else 1) * sum(usable[t][i] for i in on) / len(on))
        rank = order(outside).index(order(inside)[0]) + 1
        shares.append((rank if orientation == "replicate" else n_trials + 1 - rank) / (n_trials + 1))
    logits = [math.log(s / (1 - s)) for s in shares]
    average = lambda x: sum(x) / len(x)
    return out | {"pbo": average([float(x <= 0) for x in logits]), "combination_count": len(shares), "selected_lambda": average(logits), "selected_oos_rank_pct": average(shares)}


def deflated_sharpe(returns: DataFrame, column_name: str, n_trials: int, periods: int = 252) -> dict[str, float | int | None]:
    """Annualized Sharpe ratio, the best one expected by chance, and the deflated probability.

    Spark's population moments are turned into the bias-corrected skewness and kurtosis.
    """
    r = returns.select(F.col(column_name).cast("double").alias("r")).where("r is not null and not isnan(r)").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2")).first()
    n, normal = r["n"], NormalDist()
    out = {"dsr": None, "observed_sharpe": None, "benchmark_sharpe": None, "return_count": n}
    if n < 2 or not r["s"]:
        return out
    observed = r["m"] / r["s"] * math.sqrt(periods)
    skew = r["g1"] * math.sqrt(n * (n - 1)) / (n - 2) if n >= 3 else 0.0
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * r["g2"] + 6) + 3 if n >= 4 else 3.0
    chance = 0.0
    if n_trials > 1:
        euler = 0.5772156649015329
        chance = ((1 - euler) * normal.inv_cdf(1 - 1 / n_trials) + euler * normal.inv_cdf(1 - 1 / (n_trials * math.e))) / math.sqrt(n - 1)
    out |= {"observed_sharpe": observed, "benchmark_sharpe": chance}
    spread = 1 - skew * observed + (kurtosis - 1) / 4 * observed**2
    return out | {"dsr": normal.cdf((observed - chance) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else None}
