"""Bars and reference tables derived from the driver's star-schema tables, in Spark and in SQL.

A supplier is a symbol, a ship date a bar: price = extended price / quantity, open and
close by (order key, line number, price), volume and amount as sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("l_shipdate").alias("timestamp"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.try_divide("l_extendedprice", "l_quantity").alias("p"),
    )
    order = F.struct("l_orderkey", "l_linenumber", "p")
    return lines.groupBy("symbol", "timestamp").agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


BARS_SQL = """
bars as (
  select lpad(l_suppkey::varchar, 6, '0') as symbol, l_shipdate as timestamp, arg_min(p, k) as open, max(p) as high, min(p) as low, arg_max(p, k) as close,
    sum(l_quantity) as volume, sum(l_extendedprice) as amount
  from (select *, l_extendedprice / l_quantity as p, (l_orderkey, l_linenumber, l_extendedprice / l_quantity) as k from lineitem)
  group by 1, 2)"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("timestamp")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("close"))


BENCHMARK_SQL = "index_series as (select l_shipdate as timestamp, round(avg(l_extendedprice / l_quantity), 6) as close from lineitem group by 1)"


def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per supplier: its region from 1992 and its nation from 1995; every tenth supplier has none."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    symbol = F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol")
    early = s.select(symbol, F.lit("1992-01-01").cast("date").alias("change_date"), F.lit("region").alias("standard"), F.col("r_name").alias("sector"), F.lit(None).cast("string").alias("industry_level_1"))
    late = s.select(symbol, F.lit("1995-06-01").cast("date").alias("change_date"), F.lit("nation").alias("standard"), F.col("r_name").alias("sector"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("industry_level_1"))
    return early.unionByName(late)


INDUSTRY_SQL = """
members as (select lpad(s_suppkey::varchar, 6, '0') as symbol, r_name, n_name, n_nationkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey % 10 <> 0),
industry as (
  select symbol, date '1992-01-01' as change_date, r_name as level_1 from members
  union all select symbol, date '1995-06-01', case when n_nationkey % 2 = 0 then r_name else n_name end from members)"""


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly sums of a supplier's lines, available 45 days after the quarter's end."""
    q = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")).cast("date").alias("q"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    q = q.groupBy("symbol", "q").agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_extendedprice"), 2).alias("b"), F.round(F.sum("l_discount"), 2).alias("c"), F.round(F.sum("l_tax"), 2).alias("d"))
    report = F.date_sub(F.add_months("q", 3), 1)
    values = {
        "total_assets": F.col("b") * 3, "total_parent_equity": F.col("b"), "share_capital": F.col("a") * 100, "total_operate_income_ttm": F.col("b") * 0.5, "operate_cost_ttm": F.col("b") * 0.3,
        "operate_profit_ttm": F.col("c") * 1000, "parent_netprofit_ttm": F.col("d") * 1000, "netcash_operate_ttm": F.col("c") * 500, "asset_growth": F.col("c") - F.col("d"), "investment_to_assets": F.col("c") / 10, "accruals": F.col("d") / 10,
        "total_liabilities": F.col("b") * 2, "inventory": F.col("a") * 7, "accounts_rece": F.col("a") * 3, "monetary_funds": F.col("c") * 100, "inventory_growth": F.col("d") - 1, "receivables_growth": F.col("c") - 1, "capex_growth": F.when(F.col("a") > 200, F.col("a") / 100),
    }
    return q.select("symbol", report.alias("report_date"), F.date_add(report, 45).alias("available_date"), *(v.cast("double").alias(k) for k, v in values.items()))


FUNDAMENTALS_SQL = """
quarters as (
  select lpad(l_suppkey::varchar, 6, '0') as symbol, date_trunc('quarter', l_shipdate)::date as q, sum(l_quantity) as a, round(sum(l_extendedprice), 2) as b, round(sum(l_discount), 2) as c, round(sum(l_tax), 2) as d
  from lineitem group by 1, 2),
fundamentals as (
  select symbol, ((q + interval 3 month)::date + 44)::timestamp as available_date, b * 3 as total_assets, b as total_parent_equity, a * 100 as share_capital, b * 0.5 as total_operate_income_ttm, b * 0.3 as operate_cost_ttm,
    c * 1000 as operate_profit_ttm, d * 1000 as parent_netprofit_ttm, c * 500 as netcash_operate_ttm, c - d as asset_growth, c / 10 as investment_to_assets, d / 10 as accruals, b * 2 as total_liabilities, a * 7 as inventory,
    a * 3 as accounts_rece, c * 100 as monetary_funds, d - 1 as inventory_growth, c - 1 as receivables_growth, case when a > 200 then a / 100 end as capex_growth
  from quarters)"""


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines of suppliers that aren't multiples of 7 pay a hundredth of their discount."""
    d = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_suppkey % 7 <> 0")
    return d.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.col("l_shipdate").cast("date").alias("event_date"), (F.col("l_discount") / 100).alias("cash_dividend_per_share"))


DIVIDENDS_SQL = "dividends as (select lpad(l_suppkey::varchar, 6, '0') as symbol, l_shipdate::date as event_date, l_discount / 100 as cash from lineitem where l_returnflag = 'R' and l_suppkey % 7 <> 0)"


def scored(spark: SparkSession, sf_dir: str, horizon: int = 5) -> DataFrame:
    """Bars with close_to_sma_20 as prediction and the future return as label."""
    from barloom.operators.cross_section import with_label
    from barloom.operators.panel import factor_frame

    panel = factor_frame(bars(spark, sf_dir), ["close_to_sma_20"], keep=["symbol", "timestamp", "close"])
    return with_label(panel, horizon).select("symbol", "timestamp", F.round("close_to_sma_20", 9).alias("prediction"), F.round(f"future_return_{horizon}d", 9).alias("label"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
