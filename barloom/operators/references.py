"""Slowly changing reference data attached to bars."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import column
from barloom.functions.windows import pct_change
from barloom.operators.asof import asof
from barloom.plans.compiler import evaluate
from barloom.schema import OPTIONAL_FUNDAMENTALS, REQUIRED_FUNDAMENTALS, number, require

#: Rows of an index series above which it is joined by exchange instead of broadcast: a
#: century of minutes has fewer.
MOST_BROADCAST_ROWS = 2_000_000


def is_small(series: DataFrame) -> bool:
    """Whether an index series may be broadcast, by a bounded count."""
    return series.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS


def with_benchmark(bars: DataFrame, index: DataFrame, symbol: str = "sh000300") -> DataFrame:
    """benchmark_close_{symbol} and benchmark_return_1_{symbol} on each bar's timestamp.

    The return is computed on the whole index series first.  The series has one row per
    timestamp; it is broadcast when a bounded count shows that it is small.
    """
    time = "timestamp" if "timestamp" in index.columns else "date"
    require(index, [time, "close"], "benchmark")
    series = index.select(F.lit(symbol).alias("symbol"), F.col(time).cast("timestamp_ntz").alias("timestamp"), number(F.col("close")).alias("close"))
    series = evaluate(series, {f"benchmark_close_{symbol}": column("close"), f"benchmark_return_1_{symbol}": pct_change(column("close"))}, ["timestamp"])
    return bars.join(F.broadcast(series) if is_small(index) else series, "timestamp", "left")


def with_fundamentals(bars: DataFrame, fundamentals: DataFrame | None) -> DataFrame:
    """fund_* columns of the latest statement available at the bar.

    Required columns must exist (ValueError); optional ones become null.  Of statements
    available on one day the later report date wins.
    """
    if fundamentals is None:
        raise FileNotFoundError("fundamentals are needed by the chosen factors")
    require(fundamentals, ["symbol", "report_date", "available_date", *REQUIRED_FUNDAMENTALS], "fundamentals")
    values = [*REQUIRED_FUNDAMENTALS, *OPTIONAL_FUNDAMENTALS]
    slim = fundamentals.select("symbol", "report_date", "available_date", *((number(F.col(c)) if c in fundamentals.columns else F.lit(None).cast("double")).alias(c) for c in values))
    return asof(bars, slim, "timestamp", "available_date", tie=["report_date"], prefix="fund_")


def with_industry(bars: DataFrame, industry: DataFrame | None, standard: str | None = None) -> DataFrame:
    """industry_level_1 (sector where it is missing) as of the bar; null without data.

    ``standard`` prefers one classification and falls back to all where a symbol has
    none of it; without it the latest row of any standard counts.
    """
    if industry is None:
        return bars.withColumn("industry_level_1", F.lit(None).cast("string"))
    sector = F.col("sector") if "sector" in industry.columns else F.lit(None).cast("string")
    kind = F.col("standard") if "standard" in industry.columns else F.lit(None).cast("string")
    rows = industry.select("symbol", F.col("change_date").cast("date").alias("change_date"), kind.alias("standard"), F.coalesce(F.col("industry_level_1"), sector).alias("industry_level_1"))
    if standard is not None:
        own = F.coalesce(F.col("standard") == standard, F.lit(False))
        rows = rows.withColumn("_has", F.max(own).over(Window.partitionBy("symbol"))).where(own | ~F.col("_has")).drop("_has")
    joined = asof(bars, rows, "timestamp", "change_date", tie=["standard", "industry_level_1"], prefix="_ind_")
    return joined.withColumnRenamed("_ind_industry_level_1", "industry_level_1").drop("_ind_change_date", "_ind_standard")


def with_peer_returns(bars: DataFrame) -> DataFrame:
    """industry_return_1_level_1: the mean one-bar return of the other members of the industry.

    Bars without an industry form one group.  A sole member gets null.
    """
    own = evaluate(bars, {"_r": pct_change(column("close"))})
    group = Window.partitionBy("timestamp", "industry_level_1")
    peers = F.count("_r").over(group) - 1
    rest = F.coalesce(F.sum("_r").over(group), F.lit(0.0)) - F.col("_r")
    return own.withColumn("industry_return_1_level_1", F.when(peers > 0, F.try_divide(rest, peers))).drop("_r")


def with_dividends(bars: DataFrame, dividends: DataFrame | None, days: int = 365) -> DataFrame:
    """dividend_cash_per_share_ttm: cash with an event date in (t - ``days``, t].

    Null for every bar when there are no valid events at all for the symbol.
    """
    name = "dividend_cash_per_share_ttm"
    if dividends is None:
        return bars.withColumn(name, F.lit(None).cast("double"))
    events = dividends.select("symbol", F.col("event_date").cast("date").alias("event_date"), number(F.col("cash_dividend_per_share")).alias("cash")).where("event_date is not null and cash is not null and symbol is not null")
    daily = events.groupBy("symbol", "event_date").agg(F.sum("cash").alias("cash"))
    paid = daily.select("symbol", "event_date", F.sum("cash").over(Window.partitionBy("symbol").orderBy("event_date")).alias("paid"))
    known = daily.select("symbol").distinct().withColumn("_known", F.lit(True))
    earlier = F.col("timestamp") - F.expr(f"interval {days} days")
    now = asof(bars.withColumn("_earlier", earlier), paid, "timestamp", "event_date", prefix="_now_")
    both = asof(now, paid, "_earlier", "event_date", prefix="_then_").join(known, "symbol", "left")
    cash = F.coalesce("_now_paid", F.lit(0.0)) - F.coalesce("_then_paid", F.lit(0.0))
    return both.withColumn(name, F.when(F.col("_known"), cash)).drop("_earlier", "_known", "_now_paid", "_then_paid", "_now_event_date", "_then_event_date")


def augment(bars: DataFrame, needs: Iterable[str], benchmark: DataFrame | None = None, fundamentals: DataFrame | None = None, industry: DataFrame | None = None, dividends: DataFrame | None = None) -> DataFrame:
    """Only the joins that the chosen factors need."""
    needs = set(needs)
    if "benchmark" in needs:
        if benchmark is None:
            raise FileNotFoundError("a benchmark series is needed by the chosen factors")
        bars = with_benchmark(bars, benchmark)
    if "fundamentals" in needs:
        bars = with_fundamentals(bars, fundamentals)
    if "industry" in needs:
        bars = with_peer_returns(with_industry(bars, industry))
    if "dividends" in needs:
        bars = with_dividends(bars, dividends)
    return bars
