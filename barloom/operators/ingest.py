"""Standardization and incremental upsert of raw tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import number

BALANCE = {"TOTAL_ASSETS": "total_assets", "TOTAL_LIABILITIES": "total_liabilities", "TOTAL_PARENT_EQUITY": "total_parent_equity", "TOTAL_EQUITY": "total_equity", "SHARE_CAPITAL": "share_capital", "INVENTORY": "inventory", "ACCOUNTS_RECE": "accounts_rece", "NOTE_RECE": "note_rece", "FIXED_ASSET": "fixed_asset", "INTANGIBLE_ASSET": "intangible_asset", "MONETARYFUNDS": "monetary_funds"}
PROFIT = {"TOTAL_OPERATE_INCOME": "total_operate_income", "OPERATE_COST": "operate_cost", "OPERATE_PROFIT": "operate_profit", "PARENT_NETPROFIT": "parent_netprofit", "NETPROFIT": "netprofit"}
CASH = {"NETCASH_OPERATE": "netcash_operate", "CONSTRUCT_LONG_ASSET": "capex"}
YEAR_TO_DATE = ("total_operate_income", "operate_cost", "operate_profit", "parent_netprofit", "netcash_operate", "capex")


def day(x: Column) -> Column:
    """A date, or null where there is none."""
    return F.to_date(x.cast("string").try_cast("timestamp"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order`` (nulls first)."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def upsert(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp"), tie: list[str] | None = None) -> DataFrame:
    """Existing and new rows with new ones winning; write the result to another version.

    Rows without a readable timestamp go.  Of several new rows with one key the last by
    ``tie`` (default: all other columns) wins.
    """
    both = existing.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rest = tie if tie is not None else sorted(set(both.columns) - {*keys, "_age"})
    return keep_last(both.where(F.col(keys[-1]).isNotNull()), list(keys), ["_age", *rest]).drop("_age")


def incremental_start(requested: date, latest: date | None, end: date, lookback_days: int) -> date | None:
    """Where to load from: the overlap before the latest known day; None when it is fresh."""
    if latest is None:
        return requested
    if latest >= end:
        return None
    return max(requested, latest - timedelta(days=lookback_days))


def latest_day(df: DataFrame, candidates: Iterable[str]) -> date | None:
    """The latest day over whichever candidate columns exist."""
    own = [c for c in candidates if c in df.columns]
    row = df.agg(*(F.max(day(F.col(c))).alias(c) for c in own)).first() if own else ()
    return max((d for d in row if d is not None), default=None)


def _pick(df: DataFrame, mapping: dict[str, str], what: str) -> DataFrame:
    if "REPORT_DATE" not in df.columns:
        raise ValueError(f"{what} has no REPORT_DATE")
    col = lambda c, f: f(F.col(c)) if c in df.columns else f(F.lit(None).cast("string"))
    symbol = F.col("symbol") if "symbol" in df.columns else F.lit("").alias("symbol")
    out = df.select(symbol.alias("symbol"), day(F.col("REPORT_DATE")).alias("report_date"), col("NOTICE_DATE", day).alias("notice_date"), *(col(a, number).alias(b) for a, b in mapping.items()))
    out = out.where("report_date is not null")
    return keep_last(out, ["symbol", "report_date"], ["notice_date", *mapping.values()])


def single_quarters(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Undo year-to-date sums: the value less the previous row's of the same year.

    The first row of a year, and one after a null, keep their value; a null stays null.
    """
    w = Window.partitionBy("symbol", F.year("report_date")).orderBy("report_date")
    part = lambda c: F.col(c) - F.coalesce(F.when(F.quarter("report_date") > 1, F.lag(c).over(w)), F.lit(0.0))
    return df.select(*(part(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def fundamentals(balance: DataFrame, profit: DataFrame, cash: DataFrame) -> DataFrame:
    """Statements joined on the report date, with trailing sums, growth over four rows and the availability date."""
    b, p, c = (_pick(df, m, n).withColumnRenamed("notice_date", f"notice_{n}") for df, m, n in ((balance, BALANCE, "balance"), (profit, PROFIT, "profit"), (cash, CASH, "cash")))
    keys = ["symbol", "report_date"]
    all3 = b.join(p, keys, "full").join(c, keys, "full")
    all3 = all3.withColumn("available_date", F.coalesce("notice_balance", "notice_profit", "notice_cash", "report_date"))
    all3 = all3.withColumn("total_parent_equity", F.coalesce("total_parent_equity", "total_equity")).withColumn("parent_netprofit", F.coalesce("parent_netprofit", "netprofit"))
    q = single_quarters(all3, YEAR_TO_DATE)
    order = Window.partitionBy("symbol").orderBy("report_date")
    four = order.rowsBetween(-3, 0)
    ttm = lambda x: F.when(F.count(x).over(four) == 4, F.sum(x).over(four))
    q = q.select("*", *(ttm(x).alias(f"{x}_ttm") for x in YEAR_TO_DATE))
    ago = lambda x: F.lag(x, 4).over(order)
    growth = lambda x: F.try_divide(F.col(x), ago(x)) - 1
    return q.select(
        "symbol", "report_date", "available_date", "total_assets", "total_parent_equity", "share_capital", "total_operate_income_ttm", "operate_cost_ttm", "operate_profit_ttm", "parent_netprofit_ttm", "netcash_operate_ttm",
        growth("total_assets").alias("asset_growth"),
        F.try_divide(F.col("capex_ttm"), ago("total_assets")).alias("investment_to_assets"),
        F.try_divide(F.col("parent_netprofit_ttm") - F.col("netcash_operate_ttm"), ago("total_assets")).alias("accruals"),
        "total_liabilities", "inventory", "accounts_rece", "note_rece", "fixed_asset", "intangible_asset", "monetary_funds", "capex_ttm",
        growth("inventory").alias("inventory_growth"), growth("accounts_rece").alias("receivables_growth"), growth("capex_ttm").alias("capex_growth"),
    )


def dividends(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Dividends per share from per-ten-share cash; the event is the ex, pay or announcement date.

    ``names`` maps announcement_date, record_date, ex_date, pay_date, cash_per_ten,
    dividend_type and report_period to the raw columns (absent ones become null).
    """
    has = lambda c: F.col(names[c]) if c in names and names[c] in raw.columns else F.lit(None).cast("string")
    dates = {c: day(has(c)).alias(c) for c in ("announcement_date", "record_date", "ex_date", "pay_date")}
    rows = raw.select("symbol", *dates.values(), (number(has("cash_per_ten")) / 10).alias("cash_dividend_per_share"), has("dividend_type").alias("dividend_type"), has("report_period").alias("report_period"))
    rows = rows.withColumn("event_date", F.coalesce("ex_date", "pay_date", "announcement_date")).where("event_date is not null and cash_dividend_per_share is not null")
    return rows.select("symbol", "announcement_date", "record_date", "ex_date", "pay_date", "event_date", "cash_dividend_per_share", "dividend_type", "report_period")


def industries(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Classification changes under the standard column names; rows without a date go."""
    has = lambda c: F.col(names.get(c, c)).cast("string") if names.get(c, c) in raw.columns else F.lit(None).cast("string")
    text = ("standard", "sector", "industry_level_1", "industry_level_2", "industry_level_3", "industry_code")
    rows = raw.select("symbol", day(has("change_date")).alias("change_date"), *(has(c).alias(c) for c in text)).where("change_date is not null")
    return keep_last(rows, ["symbol", "change_date", "standard"], list(text[1:]))


def benchmark(raw: DataFrame) -> DataFrame:
    """timestamp and close of an index series."""
    time = next((c for c in ("timestamp", "date", "trade_date") if c in raw.columns), None)
    if time is None or "close" not in raw.columns:
        raise ValueError("benchmark needs a date and a close")
    return raw.select(F.col(time).cast("timestamp_ntz").alias("timestamp"), number(F.col("close")).alias("close")).where("timestamp is not null")
